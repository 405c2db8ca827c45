"""A schema as Markdown tables: a row per field with its type, size and description."""

from __future__ import annotations

from ..operators.layout import static_bits
from .model import Schema


def _size(schema: Schema, f: dict) -> str:
    n = static_bits(schema, f) if "conditional" not in f and f["type"] != "padding" else None
    return "varies" if n is None else f"{n // 8} bytes" if n % 8 == 0 else f"{n} bits"


def _kind(f: dict) -> str:
    t = f["type"]
    if t == "array":
        return f"array ({f['kind']}) of {f['items']['type']}"
    if t in ("string", "bytes"):
        return f"{t} ({f.get('kind', 'fixed')}{', ' + f['encoding'] if 'encoding' in f else ''})"
    return f"{t}" + (f" = {f['const']}" if "const" in f else f" = {f['computed']['type']}" if "computed" in f else "") + (f" if {f['conditional']}" if "conditional" in f else "")


def markdown(schema: Schema) -> str:
    out = []
    for name, spec in schema.types.items():
        out += [f"## {name}", spec.get("description", ""), ""]
        if "sequence" in spec:
            out += ["| field | type | size | description |", "|-|-|-|-|"]
            out += [f"| {f.get('name', '')} | {_kind(f)} | {_size(schema, f)} | {f.get('description', '')} |" for f in spec["sequence"]]
            out += [f"| {f['name']} | at {f['position']} | | {f.get('description', '')} |" for f in spec.get("instances", [])]
        elif spec.get("type") == "enum":
            out += ["| name | value |", "|-|-|"] + [f"| {k} | {v} |" for k, v in spec["variants"].items()]
        else:
            out.append(f"{_kind(spec)}")
        out.append("")
    return "\n".join(out)
