"""Sizes that a schema fixes."""

from __future__ import annotations

from ..schema.model import FLOATS, INTEGERS, Schema
from .decode_local import UINT


def static_bits(schema: Schema, spec: dict | str, open_: tuple = ()) -> int | None:
    """Size in bits if it never varies. A composite fills its last byte only when it is encoded on its own."""
    if isinstance(spec, str) or spec.get("type") in schema.types:
        name = spec if isinstance(spec, str) else spec["type"]
        if name in open_:
            return None
        if name in schema.types:
            own = schema.types[name]
            if own.get("instances"):
                return None
            if "sequence" not in own:
                return 8 * UINT[own["repr"]] if own.get("type") == "enum" else static_bits(schema, own, (*open_, name))
            total = 0
            for f in own["sequence"]:
                n = None if "conditional" in f or f["type"] == "padding" else static_bits(schema, f, (*open_, name))
                if n is None:
                    return None
                total += n
            return total
        return static_bits(schema, {"type": name}, open_)
    kind = spec["type"]
    if kind in INTEGERS:
        return 8 * INTEGERS[kind][0]
    if kind in FLOATS:
        return 8 * FLOATS[kind]
    if kind == "bool":
        return 8
    if kind in ("bit", "int"):
        return spec.get("size", 1)
    if kind == "bitfield":
        return sum(x["size"] for x in spec["fields"])
    if kind in ("string", "bytes") and spec.get("kind", "fixed") == "fixed":
        return 8 * spec["length"]
    if kind == "array" and spec["kind"] == "fixed":
        n = static_bits(schema, spec["items"], open_)
        return n * spec["length"] if n is not None and (n % 8 == 0) else None
    return None
