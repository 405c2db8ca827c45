"""The native path: a schema type as Column expressions, without Python on the executors.

Positions are constants as long as the layout is fixed and become helper columns behind the first
field of variable length, so no position is computed twice. What has no native form raises NotNative,
and decode() then takes the Arrow path. Reads past the end don't fail in Spark, so every message is
checked against the end of its last field."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary, expr
from ..schema.model import FLOATS, INTEGERS, Schema
from .decode_local import UINT
from .layout import static_bits
from .types import spark_type, variants


class NotNative(Exception):
    """A schema type, or a part of one, that Column expressions can't decode or encode."""


@dataclass
class _State:
    """Where the next field starts: `base` (a Column, or None at the message's start) plus `bits`."""

    df: DataFrame
    data: str
    base: Column | None = None
    bits: int = 0
    helpers: list[str] = field(default_factory=list)

    def at(self, bits: int | None = None) -> Column | int:
        n = (self.bits if bits is None else bits) // 8
        return n if self.base is None else self.base + n

    def helper(self, column: Column) -> Column:
        name = f"__bitloom_{len(self.helpers)}"
        self.df = self.df.withColumn(name, binary.once(column))
        self.helpers.append(name)
        return F.col(f"`{name}`")

    def jump(self, size: Column) -> None:
        """Continue `size` bytes on."""
        at = self.at()
        self.base, self.bits = self.helper((F.lit(at) if isinstance(at, int) else at) + size), 0


class NativeDecoder:
    def __init__(self, schema: Schema):
        self.schema, self.msb = schema, schema.bit_order == "msb_first"

    def message(self, df: DataFrame, data: str, root: str, start: int = 0) -> tuple[DataFrame, Column, Column, list[str]]:
        """(df with helper columns, value, bytes needed, helper names). Raises NotNative."""
        own = self.schema.types[root]
        state = _State(df, data, None, 8 * start)
        if "sequence" in own:
            if own.get("instances"):
                raise NotNative("fields at positions")
            value = self.composite(state, own, {})
        else:
            value = self.element(state, {"type": root}, {})
        at = state.at(state.bits + 7)
        return state.df, value, F.lit(at) if isinstance(at, int) else at, state.helpers

    def composite(self, state: _State, spec: dict, scope: dict) -> Column:
        scope, out = {"": scope}, []
        for f in spec["sequence"]:
            if f["type"] == "padding":
                if state.base is not None:
                    raise NotNative("padding behind a field of variable length")
                n = 8 * f["align_to"]
                state.bits = -(-state.bits // n) * n
                continue
            c = self.conditional(state, f, scope)
            scope[f["name"]] = c
            if self.schema.types.get(f["type"], {}).get("type") == "enum":
                scope["#" + f["name"]] = self.number  # conditions compare the number
            out.append(c.alias(f["name"]))
        return F.struct(*out) if out else F.struct(F.lit(None).cast("int").alias("_"))

    def look(self, scope: dict):
        def find(path: str) -> Column:
            if path.startswith("../") or path.startswith("_root."):
                raise NotNative("a path outwards")
            head, *rest = path.split(".")
            here = scope
            while head not in here:
                if not here.get(""):
                    return F.lit(None).cast("long")
                here = here[""]
            c = here["#" + head] if "#" + head in here and not rest else here[head]
            for p in rest:
                c = c.getField(p)
            return c

        return find

    def conditional(self, state: _State, f: dict, scope: dict) -> Column:
        if "conditional" not in f:
            return self.element(state, f, scope)
        size = static_bits(self.schema, f)
        if size is None or size % 8 or state.bits % 8:
            raise NotNative("a conditional field of variable size")
        present = state.helper(expr.condition(expr.parse(f["conditional"]), self.look(scope)))
        value = F.when(present, self.element(state, {k: v for k, v in f.items() if k != "conditional"}, scope))
        state.bits -= size
        state.jump(F.when(present, F.lit(size // 8)).otherwise(F.lit(0)))
        return value

    def take(self, state: _State, n: int) -> Column:
        if state.bits % 8:
            raise NotNative("bytes off a byte boundary")
        raw = binary.window(F.col(f"`{state.data}`"), state.at(), n)
        state.bits += 8 * n
        return raw

    def bits(self, state: _State, n: int) -> Column:
        first, last = state.bits // 8, (state.bits + n + 7) // 8
        size = last - first
        if size > 7:
            raise NotNative("bits over more than 7 bytes")
        at = first if state.base is None else state.base + first
        word = binary.unsigned(binary.window(F.col(f"`{state.data}`"), at, size), size, self.msb)
        skip = state.bits % 8
        shift = 8 * size - skip - n if self.msb else skip
        state.bits += n
        return F.shiftright(word, shift).bitwiseAND(F.lit((1 << n) - 1))

    def element(self, state: _State, f: dict, scope: dict) -> Column:
        kind, big = f["type"], self.schema.big(f)
        own = self.schema.types.get(kind)
        if own is not None:
            if "sequence" in own:
                if own.get("instances"):
                    raise NotNative("fields at positions")
                return self.composite(state, own, scope)
            return self.enum(state, own) if own.get("type") == "enum" else self.element(state, own, scope)
        if kind in INTEGERS:
            size, is_signed = INTEGERS[kind]
            raw = self.take(state, size)
            return (binary.signed if is_signed else binary.unsigned)(raw, size, big).cast(spark_type(self.schema, f))
        if kind in FLOATS:
            return binary.real(self.take(state, FLOATS[kind]), FLOATS[kind], big)
        if kind == "bool":
            return binary.unsigned(self.take(state, 1), 1) != 0
        if kind == "bit" and f.get("size", 1) < 56:
            return self.bits(state, f.get("size", 1))
        if kind == "int" and f["size"] < 56:
            n = self.bits(state, f["size"])
            return n - F.when(n >= 1 << f["size"] - 1, 1 << f["size"]).otherwise(0)
        if kind == "bitfield":
            return F.struct(*[self.bits(state, x["size"]).alias(x["name"]) for x in f["fields"]])
        if kind == "string":
            return self.string(state, f, scope)
        if kind == "bytes":
            return self.counted(state, f, scope)[0]
        if kind == "array":
            return self.array(state, f, scope)
        if kind == "optional":
            value = f["value_type"]
            inner = value if isinstance(value, dict) else {"type": value}
            size = static_bits(self.schema, inner)
            if size is None or size % 8 or f.get("presence_type") == "bit":
                raise NotNative("an optional of variable size")
            present = state.helper(binary.unsigned(self.take(state, 1), 1) != 0)
            v = F.when(present, self.element(state, inner, scope))
            state.bits -= size
            state.jump(F.when(present, F.lit(size // 8)).otherwise(F.lit(0)))
            return v
        if kind in ("discriminated_union", "choice"):
            return self.union(state, f, scope)
        raise NotNative(kind)

    def enum(self, state: _State, spec: dict) -> Column:
        n = binary.unsigned(self.take(state, UINT[spec["repr"]]), UINT[spec["repr"]], self.schema.big(spec))
        self.number, out = n, None
        for name, code in spec["variants"].items():
            out = F.when(n == code, F.lit(name)) if out is None else out.when(n == code, F.lit(name))
        return out.when(n.isNotNull(), F.raise_error(F.concat(F.lit("INVALID_VALUE: no value of the enum: "), n.cast("string"))))

    def count(self, state: _State, f: dict, scope: dict) -> Column | int:
        kind = f.get("kind", "fixed")
        if kind == "fixed":
            return f["length"]
        if kind in ("length_prefixed", "byte_length_prefixed"):
            size = UINT.get(f.get("length_type", "uint8"))
            if size is None or size == 8:
                raise NotNative("a length of variable size")
            return state.helper(binary.unsigned(self.take(state, size), size, self.schema.big(f)).try_cast("int").cast("long"))
        if kind == "field_referenced":
            return state.helper(self.look(scope)(f["length_field"]).try_cast("int").cast("long"))
        if kind == "computed_count":
            return state.helper(expr.to_column(expr.parse(f["count_expr"], counts=True), self.look(scope)).try_cast("int").cast("long"))
        if kind == "eof_terminated":
            at = state.at()
            return state.helper(F.octet_length(F.col(f"`{state.data}`")).cast("long") - (F.lit(at) if isinstance(at, int) else at))
        raise NotNative(kind)

    def counted(self, state: _State, f: dict, scope: dict) -> tuple[Column, bool]:
        n = self.count(state, f, scope)
        if isinstance(n, int):
            return self.take(state, n), True
        if state.bits % 8:
            raise NotNative("bytes off a byte boundary")
        raw = binary.window(F.col(f"`{state.data}`"), state.at(), n)
        state.jump(n)
        return raw, False

    def string(self, state: _State, f: dict, scope: dict) -> Column:
        if f.get("kind", "fixed") == "eof_terminated":
            raise NotNative("a string to the end")
        raw, _ = self.counted(state, f, scope)
        return binary.text(raw, f.get("encoding", "utf8"), self.schema.big(f), f.get("kind", "fixed") == "fixed")

    def array(self, state: _State, f: dict, scope: dict) -> Column:
        size = static_bits(self.schema, f["items"])
        if size is None or size % 8 or size == 0 or state.bits % 8:
            raise NotNative("items of variable size")
        stride, n = size // 8, self.count(state, f, scope)
        if f["kind"] in ("byte_length_prefixed", "eof_terminated"):
            n = F.floor(n / stride)  # a partial item at the end is left out
        at, count = state.at(), F.lit(n) if isinstance(n, int) else n
        base = F.lit(at) if isinstance(at, int) else at

        def item(i: Column) -> Column:
            inner = _State(state.df, state.data, base + i * stride, 0)
            value = self.element(inner, f["items"], scope)
            if inner.helpers:
                raise NotNative("items with positions of their own")
            return value

        value = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), item)).otherwise(F.array().cast(spark_type(self.schema, f)))
        if isinstance(n, int):
            state.bits += n * size
        else:
            state.jump(n * stride)
        return value

    def union(self, state: _State, f: dict, scope: dict) -> Column:
        if state.bits % 8:
            raise NotNative("a union off a byte boundary")
        at, data = state.at(), F.col(f"`{state.data}`")
        if f["type"] == "choice":
            first = {n: self.schema.types[n]["sequence"][0] for n in variants(f)}
            size = UINT[next(iter(first.values()))["type"]]
            value = binary.unsigned(binary.window(data, at, size), size, self.schema.big(next(iter(first.values()))))
            tests = [(value == c["const"], n) for n, c in first.items()]
        else:
            by = f["discriminator"]
            if "peek" in by:
                value = binary.unsigned(binary.window(data, at, UINT[by["peek"]]), UINT[by["peek"]], self.schema.big(by))
            else:
                value = self.look(scope)(by["field"])
            look = lambda n: value if n == "value" else self.look(scope)(n)
            tests = [(expr.condition(expr.parse(v["when"]), look) if v.get("when") else F.lit(True), v["type"]) for v in f["variants"]]
        which = None
        for test, name in tests:
            which = F.when(test, F.lit(name)) if which is None else which.when(test, F.lit(name))
        which = state.helper(which.when(F.octet_length(data).isNotNull(), F.raise_error(F.concat(F.lit("INVALID_VARIANT: no variant is for "), value.cast("string")))))
        if f.get("byte_budget"):
            budget = state.helper(self.look(scope)(f["byte_budget"]["field"]).try_cast("int").cast("long"))
            state.helper(binary.window(data, at, budget))
            part, parts = state.helpers[-1], []  # the variants see these bytes only
            for name in dict.fromkeys(n for _, n in tests):
                parts.append(self._variant(state, _State(state.df, part), name, which, {}))
            state.jump(budget)
        else:
            sizes, parts = None, []
            for name in dict.fromkeys(n for _, n in tests):
                inner = _State(state.df, state.data, state.base, state.bits)
                parts.append(self._variant(state, inner, name, which, scope))
                own = inner.at()
                own = F.lit(own) if isinstance(own, int) else own
                sizes = F.when(which == name, own) if sizes is None else sizes.when(which == name, own)
            state.base, state.bits = state.helper(sizes), 0
        return F.struct(which.alias("type"), *parts)

    def _variant(self, state: _State, inner: _State, name: str, which: Column, scope: dict) -> Column:
        inner.df, inner.helpers = state.df, state.helpers
        own = F.when(which == name, self.element(inner, {"type": name}, scope)).alias(name)
        state.df = inner.df
        inner.bits = -(-inner.bits // 8) * 8
        return own


def hex_message(schema: Schema, root: str, value: Column) -> Column:
    """The native encoder: hex digits of a message from a struct column. Raises NotNative."""
    return _HexEncoder(schema).composite(schema.types[root], value, ()) if "sequence" in schema.types[root] else _HexEncoder(schema).element(schema.types[root], value, {}, ())


class _HexEncoder:
    def __init__(self, schema: Schema):
        self.schema, self.msb = schema, schema.bit_order == "msb_first"

    def composite(self, spec: dict, value: Column, open_: tuple) -> Column:
        """Fields in order. Computed ones are derived from the hex digits of their targets."""
        parts: list[tuple[str, Column | None]] = []
        done: dict[str, Column] = {}
        held: list[tuple[Column, int]] = []
        sequence = spec["sequence"]
        for f in sequence:
            if f["type"] in ("bit", "bitfield"):
                for name, n in [(x["name"], x["size"]) for x in f["fields"]] if f["type"] == "bitfield" else [(None, f.get("size", 1))]:
                    own = value.getField(f["name"]) if name is None else value.getField(f["name"]).getField(name)
                    held.append((F.lit(f["const"]).cast("long") if "const" in f else self.required(f["name"], own, own.cast("long")), n))
                if sum(n for _, n in held) % 8 == 0:
                    parts.append((f["name"], self.packed(held)))
                    held = []
                continue
            if held:
                raise NotNative("bits that fill no byte")
            if "computed" in f:
                parts.append((f["name"], None))
            elif "const" in f:
                parts.append((f["name"], self.element(f, F.lit(f["const"]), spec, open_)))
            elif f["type"] == "padding":
                raise NotNative("padding")
            else:
                own = self.element(f, value.getField(f["name"]), spec, open_)
                if f["type"] != "optional":
                    own = self.required(f["name"], value.getField(f["name"]), own)
                if "conditional" in f:
                    look = lambda p, v=value: self.known(sequence, v, p)
                    own = F.when(expr.condition(expr.parse(f["conditional"]), look), own).otherwise(F.lit(""))
                parts.append((f["name"], own))
            if parts[-1][1] is not None:
                done[f["name"]] = parts[-1][1]
        if held:
            raise NotNative("bits that fill no byte")
        out = []
        fields = {f.get("name"): f for f in sequence}
        for name, part in parts:
            out.append(part if part is not None else self.computed(fields[name], fields, value, done, parts))
        return F.concat(*out) if out else F.lit("")

    def required(self, name: str, given: Column, out: Column) -> Column:
        return F.when(given.isNull(), F.raise_error(F.lit(f"SCHEMA_MISMATCH: field {name!r} is missing"))).otherwise(out)

    def known(self, sequence: list[dict], value: Column, path: str) -> Column:
        """What a condition compares: of an enum the number."""
        own = next((self.schema.types.get(f["type"], {}) for f in sequence if f.get("name") == path), {})
        if own.get("type") != "enum":
            return self.path(value, path)
        out, name = None, value.getField(path)
        for n, code in own["variants"].items():
            out = F.when(name == n, F.lit(code)) if out is None else out.when(name == n, F.lit(code))
        return out

    def path(self, value: Column, path: str) -> Column:
        for p in path.split("."):
            value = value.getField(p)
        return value

    def packed(self, held: list[tuple[Column, int]]) -> Column:
        total = sum(n for _, n in held)
        if total > 56:
            raise NotNative("a run of more than 56 bits")
        word, used = F.lit(0).cast("long"), 0
        for v, n in held:
            bad = (v < 0) | (v >= 1 << n)
            v = F.when(bad, F.raise_error(F.lit(f"INVALID_VALUE: no {n} bits"))).otherwise(v)
            word = word.bitwiseOR(F.shiftleft(v.cast("long"), total - used - n if self.msb else used))
            used += n
        return binary.hex_integer(word, total // 8, self.msb)

    def computed(self, f: dict, fields: dict, value: Column, done: dict, parts: list) -> Column:
        c, extra = f["computed"], f["computed"].get("offset", 0)
        target = c.get("target", "")
        if c["type"] == "sum_of_sizes" and all(t in done for t in c["targets"]):
            n = sum((F.length(done[t]) / 2 for t in c["targets"]), F.lit(0))
        elif target not in done:
            raise NotNative("a target elsewhere")
        elif c["type"] == "crc32_of":
            spec = fields[target]
            bare = {**spec, "kind": "eof_terminated"} if spec["type"] in ("array", "bytes") else spec  # without its prefix
            n = F.crc32(F.unhex(self.element(bare, value.getField(target), {}, ())))
        elif c["type"] in ("length_of", "count_of"):
            spec, own = fields[target], value.getField(target)
            if spec["type"] == "string" and "encoding" not in c:
                n = F.octet_length(F.encode(own, "UTF-16BE")) / 2
            elif spec["type"] == "string":
                n = F.octet_length(F.encode(own, {"utf16": "UTF-16BE", "utf8": "UTF-8"}.get(c["encoding"], "ISO-8859-1")))
            elif spec["type"] == "array":
                n = F.size(own)
            elif spec["type"] == "bytes":
                n = F.octet_length(own)
            elif spec["type"] in self.schema.types or spec["type"] == "discriminated_union":
                n = F.length(done[target]) / 2
            else:
                n = own
        elif c["type"] == "position_of":
            n = F.lit(0)
            for name, part in parts:
                if name == target:
                    break
                size = static_bits(self.schema, fields[name]) if part is None else None
                if part is None and size is None:
                    raise NotNative("a position behind a computed field of variable size")
                n = n + (F.lit(size // 8) if part is None else F.length(part) / 2)
        else:
            raise NotNative(c["type"])
        plain = {k: v for k, v in f.items() if k != "computed"}
        # Bound, because writing an integer names its value several times.
        return F.element_at(F.transform(F.array(n.cast("long") + extra), lambda x: self.element(plain, x, {}, ())), 1)

    def element(self, f: dict, v: Column, spec: dict, open_: tuple) -> Column:
        kind, big = f["type"], self.schema.big(f)
        own = self.schema.types.get(kind)
        if own is not None:
            if kind in open_:
                raise NotNative("a type within itself")
            if "sequence" in own:
                return self.composite(own, v, (*open_, kind))
            if own.get("type") == "enum":
                out = None
                for name, code in own["variants"].items():
                    out = F.when(v == name, F.lit(code)) if out is None else out.when(v == name, F.lit(code))
                code = out.otherwise(F.raise_error(F.concat(F.lit("INVALID_VALUE: no name of the enum: "), v)))
                return binary.hex_integer(code, UINT[own["repr"]], self.schema.big(own))
            return self.element(own, v, spec, (*open_, kind))
        if kind in INTEGERS:
            return binary.hex_integer(v, *INTEGERS[kind][:1], big, INTEGERS[kind][1])
        if kind == "bool":
            return F.when(v, "01").otherwise("00")
        if kind == "string":
            return self.sized(f, F.encode(v, {"utf8": "UTF-8", "utf16": "UTF-16BE" if big else "UTF-16LE"}.get(f.get("encoding", "utf8"), "ISO-8859-1")))
        if kind == "bytes":
            return self.sized(f, v)
        if kind == "array" and f["kind"] in ("fixed", "length_prefixed", "field_referenced", "eof_terminated", "computed_count", "byte_length_prefixed"):
            body = F.array_join(F.transform(v, lambda x: self.element(f["items"], x, spec, open_)), "")
            if f["kind"] == "length_prefixed":
                return F.concat(self.prefix(f, F.size(v)), body)
            if f["kind"] == "byte_length_prefixed":
                return F.concat(self.prefix(f, (F.length(body) / 2).cast("long")), body)
            if f["kind"] == "fixed":
                return F.when(F.size(v) != f["length"], F.raise_error(F.lit("INVALID_VALUE: a fixed array of another length"))).otherwise(body)
            return body
        if kind == "optional":
            value = f["value_type"]
            inner = self.element(value if isinstance(value, dict) else {"type": value}, v, spec, open_)
            if f.get("presence_type") == "bit":
                raise NotNative("a presence bit")
            return F.when(v.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), inner))
        if kind in ("discriminated_union", "choice"):
            out = None
            for name in variants(f):
                part = self.element({"type": name}, v.getField(name), spec, open_)
                out = F.when(v.getField("type") == name, part) if out is None else out.when(v.getField("type") == name, part)
            return out.otherwise(F.raise_error(F.lit("INVALID_VARIANT: no variant of the union")))
        raise NotNative(kind)

    def prefix(self, f: dict, n: Column) -> Column:
        size = UINT.get(f.get("length_type", "uint8"))
        if size is None:
            raise NotNative("a length of variable size")
        return binary.hex_integer(n, size, self.schema.big(f))

    def sized(self, f: dict, raw: Column) -> Column:
        kind, h = f.get("kind", "fixed"), F.hex(raw)
        if kind == "fixed":
            return F.rpad(h, 2 * f["length"], "0")
        if kind in ("length_prefixed", "byte_length_prefixed"):
            return F.concat(self.prefix(f, F.octet_length(raw)), h)
        if kind == "null_terminated":
            return F.concat(h, F.lit("0000" if f.get("encoding") == "utf16" else "00"))
        return h
