"""The rules a schema must keep. All breaches are collected before any is reported."""

from __future__ import annotations

import re

from ..errors import SchemaError
from ..functions import expr
from .model import BUILT_IN, INTEGERS, Schema

UINT_BITS = {"uint8": 8, "uint16": 16, "uint32": 32, "uint64": 64}
NUMERIC = {*INTEGERS, "bit", "varlength", "int"}
RESERVED = re.compile(r"__")  # the generated names of readers start with it
ENCODINGS, VARINTS = {"ascii", "utf8", "utf16", "latin1"}, {"der", "leb128", "ebml", "vlq"}
ARRAY_NEEDS = {"fixed": ["length"], "length_prefixed": ["length_type"], "length_prefixed_items": ["length_type", "item_length_type"], "byte_length_prefixed": ["length_type"], "field_referenced": ["length_field"], "null_terminated": [], "signature_terminated": ["terminator_value", "terminator_type"], "eof_terminated": [], "variant_terminated": ["terminal_variants"], "computed_count": ["count_expr"]}
COMPUTED = {"length_of", "count_of", "crc32_of", "position_of", "sum_of_sizes", "sum_of_type_sizes"}


def validate(schema: Schema) -> None:
    if found := problems(schema):
        raise SchemaError(found)


def problems(schema: Schema) -> list[str]:
    return _Checker(schema).run()


class _Checker:
    def __init__(self, schema: Schema):
        self.schema, self.types, self.out = schema, schema.types, []

    def say(self, text: str) -> None:
        self.out.append(f"{self.where}: {text}")

    def run(self) -> list[str]:
        for name, spec in self.types.items():
            self.where = name
            if not re.match(r"[A-Z]", name):
                self.say("a type's name starts with an upper-case letter, which no built-in one does")
            if "sequence" in spec:
                self.composite(name, spec)
            elif spec.get("type") == "enum":
                self.enum(spec)
            elif "type" in spec:
                self.element(spec, {}, [], None)
            else:
                self.say("a type has a sequence or is an alias")
        self.cycles()
        return self.out

    def enum(self, spec: dict) -> None:
        values = spec.get("variants", {})
        if spec.get("repr") not in ("uint8", "uint16", "uint32"):
            return self.say(f"an enum can't be stored as {spec.get('repr')!r}")
        if not values:
            self.say("an enum has at least one value")
        if len(set(values.values())) < len(values):
            self.say("two names of an enum have one value")
        for k, n in values.items():
            if not 0 <= n < 1 << UINT_BITS[spec["repr"]]:
                self.say(f"value {n} of {k} does not fit {spec['repr']}")

    def composite(self, name: str, spec: dict) -> None:
        fields = {f.get("name"): f for f in spec["sequence"]}
        before: list[str] = []
        for f in spec["sequence"]:
            own = f.get("name")
            self.where = f"{name}.{own or f.get('type')}"
            if own is None and f.get("type") != "padding":
                self.say("a field has a name")
            if own is not None and RESERVED.match(own):
                self.say("names that start with __ are reserved")
            if own in before:
                self.say("the name is used twice")
            if "const" in f and "computed" in f:
                self.say("a field is constant or computed, not both")
            if "conditional" in f:
                self.expression(f["conditional"], False)
            if "const" in f and f.get("type") in UINT_BITS and not 0 <= f["const"] < 1 << UINT_BITS[f["type"]]:
                self.say(f"{f['const']} does not fit {f['type']}")
            if f.get("type") == "string" and isinstance(f.get("const"), str) and (f.get("kind") != "fixed" or len(f["const"].encode()) > f.get("length", 0)):
                self.say("a constant text is of fixed length and fits it")
            if "computed" in f:
                self.computed(f, fields, before)
            self.element(f, fields, before, name)
            before.append(own)
        for f in spec.get("instances", []):
            self.where = f"{name}.{f.get('name')}"
            if f.get("name") in before:
                self.say("the name is used twice")
            kind = f.get("type")
            if isinstance(kind, str) and kind not in self.types and kind not in BUILT_IN:
                self.say(f"there is no type {kind!r}")
            if isinstance(kind, dict):
                self.union({"type": "discriminated_union", **kind}, fields, before, name)
            for key in ("position", "size"):
                ref = f.get(key)
                if isinstance(ref, str) and "." not in ref and not ref.startswith("_root"):
                    host = fields.get(ref)
                    if host is None and ref not in [x["name"] for x in spec.get("instances", [])]:
                        self.say(f"{key} names no field {ref!r}")
                    elif host is not None and host.get("type") not in NUMERIC:
                        self.say(f"{key} field {ref!r} is no number")
            n = f.get("alignment")
            if n is not None and (n < 1 or n & n - 1):
                self.say("an alignment is a power of two")
            before.append(f.get("name"))

    def expression(self, text: str, counts: bool) -> set[str]:
        try:
            return expr.names(expr.parse(text, counts))
        except expr.ExprError as e:
            self.say(str(e))
            return set()

    def computed(self, f: dict, fields: dict, before: list[str]) -> None:
        c, kind = f["computed"], f["computed"].get("type")
        if kind not in COMPUTED:
            return self.say(f"nothing computes {kind!r}")
        if f["type"] not in UINT_BITS and f["type"] != "varlength":
            self.say(f"a {f['type']} field can't be computed")
        if kind == "crc32_of" and f["type"] != "uint32":
            self.say("a CRC-32 is a uint32")
        if "from_after_field" in c:
            if "target" in c:
                self.say("a target or from_after_field, not both")
            if kind != "length_of":
                self.say("from_after_field belongs to length_of")
            ref = c["from_after_field"]
            if ref not in fields or ref not in before and ref != f.get("name"):
                self.say(f"from_after_field names no earlier field {ref!r}")
            return
        if kind == "sum_of_sizes":
            if not c.get("targets"):
                self.say("sum_of_sizes has targets")
            return
        target = c.get("target")
        if not target:
            return self.say(f"{kind} has a target")
        if kind == "sum_of_type_sizes" and c.get("element_type") not in self.types:
            self.say(f"there is no type {c.get('element_type')!r}")
        for how, wanted in re.findall(r"\[(first|last|corresponding)<([^>]*)>\]", target):
            if wanted not in self.types:
                self.say(f"{how}<{wanted}> names no type")
        if not re.search(r"[.\[/]", target):
            host = fields.get(target)
            if host is None:
                return self.say(f"the target {target!r} is no field")
            if kind == "crc32_of" and not (host["type"] == "bytes" or host["type"] == "array" and host.get("items", {}).get("type") == "uint8" or host["type"] in self.types):
                self.say("the target of crc32_of is an array of uint8")

    def element(self, f: dict, fields: dict, before: list[str], owner: str | None) -> None:
        kind = f.get("type")
        if kind not in BUILT_IN and kind not in self.types:
            return self.say(f"there is no type {kind!r}")
        if kind in ("bit", "int") and not 1 <= f.get("size", 0) <= 64:
            self.say("bits have a size from 1 to 64")
        elif kind == "bitfield":
            parts = f.get("fields", [])
            if sum(x["size"] for x in parts) > f.get("size", 0):
                self.say("the parts of a bitfield are larger than it")
            if len({x["name"] for x in parts}) < len(parts):
                self.say("two parts of a bitfield have one name")
        elif kind == "varlength" and f.get("encoding") not in VARINTS:
            self.say(f"there is no encoding {f.get('encoding')!r}")
        elif kind == "padding" and f.get("align_to", 0) < 1:
            self.say("padding has align_to")
        elif kind == "optional":
            value = f.get("value_type")
            value = value if isinstance(value, dict) else {"type": value}
            if value.get("type") in ("optional", "bit"):
                self.say(f"an optional {value['type']} isn't possible")
            self.element(value, fields, before, owner)
        elif kind in ("string", "bytes", "array"):
            self.sized(f, fields, before, owner)
        elif kind == "discriminated_union":
            self.union(f, fields, before, owner)
        elif kind == "choice":
            self.choice(f)
        elif kind == "back_reference":
            bits, mask = UINT_BITS.get(f.get("storage"), 0), int(f.get("offset_mask", "0"), 16)
            if bits not in (8, 16, 32):
                self.say("a back reference is stored in 8, 16 or 32 bits")
            if not mask or mask >> bits:
                self.say("the offset mask is not zero and fits the storage")
            if bits > 8 and "endianness" not in f and "config" not in f and self.schema.endianness is None:
                self.say("the storage needs an endianness")
            if f.get("target_type") not in self.types:
                self.say(f"there is no type {f.get('target_type')!r}")

    def sized(self, f: dict, fields: dict, before: list[str], owner: str | None) -> None:
        kind, own = f["type"], f.get("kind", "fixed")
        if own not in ARRAY_NEEDS or kind == "string" and own not in ("fixed", "length_prefixed", "field_referenced", "null_terminated"):
            return self.say(f"there is no {kind} of kind {own!r}")
        for key in ARRAY_NEEDS[own]:
            if key not in f:
                self.say(f"a {own} {kind} needs {key}")
        if kind == "string" and f.get("encoding", "utf8") not in ENCODINGS:
            self.say(f"there is no encoding {f['encoding']!r}")
        ref = f.get("length_field") if own == "field_referenced" else None
        if ref and owner and not ref.startswith(("../", "_root.")) and ref.split(".")[0] in fields and ref.split(".")[0] not in before:
            self.say(f"length_field {ref!r} comes later")
        if own == "computed_count" and "count_expr" in f:
            for n in self.expression(f["count_expr"], True):
                if owner and n.split(".")[0] in fields and n.split(".")[0] not in before:
                    self.say(f"the count uses the later field {n!r}")
        for n in f.get("terminal_variants") or []:
            if n not in self.types:
                self.say(f"there is no type {n!r}")
        if kind == "array" and "items" in f:
            self.element(f["items"], fields, before, owner)
        elif kind == "array":
            self.say("an array has items")

    def union(self, f: dict, fields: dict, before: list[str], owner: str | None) -> None:
        by = f.get("discriminator") or {}
        if ("peek" in by) == ("field" in by):
            self.say("a discriminator peeks or names a field")
        if by.get("peek") in ("uint16", "uint32") and "endianness" not in by:
            self.say(f"a {by['peek']} peek needs an endianness")
        ref = by.get("field", "").split(".")[0]
        if owner and ref and not by["field"].startswith(("../", "_root.")) and ref in fields and ref not in before:
            self.say(f"the discriminator {ref!r} comes later")
        budget = (f.get("byte_budget") or {}).get("field")
        if budget and owner and (budget not in fields or fields[budget].get("type") not in NUMERIC or budget not in before):
            self.say(f"the byte budget {budget!r} is no earlier number")
        own = f.get("variants") or []
        for k, v in enumerate(own):
            if v.get("type") not in self.types:
                self.say(f"there is no type {v.get('type')!r}")
            if "when" in v:
                self.expression(v["when"], False)
            elif k + 1 < len(own):
                self.say("the variant without a condition is the last")
        if not any("when" in v for v in own):
            self.say("at least one variant has a condition")

    def choice(self, f: dict) -> None:
        own = [c.get("type") for c in f.get("choices") or []]
        if len(own) < 2:
            return self.say("a choice has two types or more")
        firsts = []
        for n in own:
            first = (self.types.get(n, {}).get("sequence") or [{}])[0]
            if "const" not in first or first.get("type") not in ("uint8", "uint16", "uint32"):
                self.say(f"{n!r} does not start with a constant")
            firsts.append((first.get("name"), first.get("type"), first.get("const")))
        if len({x[:2] for x in firsts}) > 1:
            self.say("the choices start with fields of different names or types")
        if len({x[2] for x in firsts}) < len(firsts):
            self.say("two choices start with one constant")

    def cycles(self) -> None:
        """A type may contain itself only where a value can end: in arrays, optionals, conditional
        fields, unions and choices."""
        hard: dict[str, set[str]] = {}
        for name, spec in self.types.items():
            hard[name] = {f["type"] for f in spec.get("sequence", []) if f.get("type") in self.types and "conditional" not in f}
            if spec.get("type") == "back_reference":
                hard[name] |= {spec.get("target_type")} & {n for n, s in self.types.items() if s.get("type") == "back_reference"}
            if spec.get("type") in self.types:
                hard[name].add(spec["type"])
        done: set[str] = set()
        for start in self.types:
            todo, path = [(start, ())], ()
            while todo:
                at, path = todo.pop()
                if at in path:
                    if at not in done:
                        self.where = at
                        self.say("the type contains itself: " + " > ".join([*path[path.index(at) :], at]))
                        done |= set(path)
                    continue
                if at not in done:
                    todo += [(n, (*path, at)) for n in hard.get(at, ())]
