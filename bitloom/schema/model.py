"""A schema: named types over byte and bit fields, defaults, and at most one protocol."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field

INTEGERS = {f"{s}int{n}": (n // 8, not s) for s in ("u", "") for n in (8, 16, 32, 64)}  # name -> (bytes, signed)
FLOATS = {"float32": 4, "float64": 8}
BUILT_IN = {*INTEGERS, *FLOATS, "bool", "bit", "int", "bitfield", "varlength", "string", "bytes", "array", "optional", "discriminated_union", "choice", "back_reference", "padding"}
GENERIC = re.compile(r"^([A-Za-z_]\w*)<(.+)>$")

_JSON5 = re.compile(r"""("(?:[^"\\]|\\.)*")|('(?:[^'\\]|\\.)*')|(//[^\n]*|/\*.*?\*/)|([A-Za-z_$][\w$]*)(?=\s*:)|(\b0[xX][0-9A-Fa-f]+\b)|(,)(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]])""", re.S)


def _json(m: re.Match) -> str:
    double, single, comment, name, number, comma = m.groups()
    if double is not None:
        return double
    if single is not None:
        return json.dumps(single[1:-1].replace("\\'", "'"))
    if comment is not None or comma is not None:
        return ""
    return json.dumps(name) if name is not None else str(int(number, 16))


def loads(text: str) -> dict:
    """JSON with comments, trailing commas, bare keys, single quotes and hex numbers."""
    return json.loads(_JSON5.sub(_json, text))


@dataclass
class Schema:
    types: dict[str, dict]
    endianness: str = "big_endian"
    bit_order: str = "msb_first"
    protocol: dict | None = None
    meta: dict = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict) -> Schema:
        config = raw.get("config") or {}
        return cls(copy.deepcopy(raw.get("types") or {}), config.get("endianness", "big_endian"), config.get("bit_order", "msb_first"), copy.deepcopy(raw.get("protocol")), raw.get("meta") or {})

    def big(self, spec: dict) -> bool:
        return spec.get("endianness", self.endianness) == "big_endian"

    def concrete(self) -> Schema:
        """Every use of a template Name<T> as a type of its own."""
        out, todo = Schema({k: v for k, v in self.types.items() if "<" not in k}, self.endianness, self.bit_order, self.protocol, self.meta), list(self.types.values())
        templates = {m[1]: (m[2], v) for k, v in self.types.items() if (m := GENERIC.match(k))}

        def filled(x: object, name: str, by: str) -> object:
            if isinstance(x, dict):
                return {k: filled(v, name, by) for k, v in x.items()}
            if isinstance(x, list):
                return [filled(v, name, by) for v in x]
            return re.sub(rf"\b{re.escape(name)}\b", by, x) if isinstance(x, str) and (x == name or f"<{name}>" in x) else x

        def uses(x: object):
            if isinstance(x, dict):
                for v in x.values():
                    yield from uses(v)
            elif isinstance(x, list):
                for v in x:
                    yield from uses(v)
            elif isinstance(x, str) and GENERIC.match(x):
                yield x

        todo = [v for k, v in self.types.items() if "<" not in k]
        while todo:
            for use in uses(todo.pop()):
                head, by = GENERIC.match(use).groups()
                if use not in out.types and head in templates:
                    out.types[use] = filled(copy.deepcopy(templates[head][1]), templates[head][0], by)
                    todo.append(out.types[use])
        return out


def load(source: str | dict, check: bool = True) -> Schema:
    """A schema from a dict or from JSON text, checked, with its protocol as a Frame type and
    templates made concrete."""
    from .protocol import framed
    from .validate import validate

    raw = loads(source) if isinstance(source, str) else source
    schema = Schema.of(raw)
    if schema.protocol:
        schema = framed(schema)
    schema = schema.concrete()
    if check:
        validate(schema)
    return schema
