"""A protocol (header, message codes, payload types) as an ordinary Frame type."""

from __future__ import annotations

import copy

from ..errors import SchemaError
from .model import INTEGERS, Schema


def message_code(code: object) -> int:
    """1, "1" and "0x01" are the same code."""
    if isinstance(code, bool) or not isinstance(code, (int, str)):
        raise SchemaError([f"message code {code!r} is no number"])
    try:
        return code if isinstance(code, int) else int(code.strip(), 0)
    except ValueError:
        raise SchemaError([f"message code {code!r} is no number"]) from None


def normalized(code: object) -> str:
    n = message_code(code)
    return f"0x{n:02X}"


def problems(schema: Schema) -> list[str]:
    p, out = schema.protocol or {}, []
    messages = p.get("messages") or []
    if not messages:
        out.append("the protocol has no messages")
    header = schema.types.get(p.get("header", ""))
    if header is None or "sequence" not in header:
        return [*out, f"header type {p.get('header')!r} is not a composite type"]
    fields = {f.get("name"): f for f in header["sequence"]}
    if "payload" in fields:
        out.append("the header has a field named payload, which is reserved")
    seen: set[int] = set()
    for m in messages:
        code = message_code(m.get("code"))
        if code in seen:
            out.append(f"message code {normalized(code)} is used twice")
        seen.add(code)
        payload = schema.types.get(m.get("payload_type", ""))
        if payload is None:
            out.append(f"payload type {m.get('payload_type')!r} of message {m.get('name')!r} is missing")
            continue
        for f in payload.get("sequence", []):
            if f.get("name") in fields:
                out.append(f"field {f['name']!r} is in the header and in payload {m['payload_type']!r}")
    names = [m.get("name") for m in messages]
    out += [f"message name {n!r} is used twice" for n in {n for n in names if names.count(n) > 1}]
    by = p.get("discriminator")
    if by and by.split(".")[0] not in fields:
        out.append(f"discriminator {by!r} is no field of the header")
    if not by and len(messages) > 1:
        out.append("several messages need a discriminator")
    if (size := p.get("header_size_field")) and size.split(".")[0] not in fields:
        out.append(f"header_size_field {size!r} is no field of the header")
    for group in p.get("message_groups") or []:
        out += [f"group {group.get('name')!r} names the unknown code {c!r}" for c in group.get("messages", []) if message_code(c) not in seen]
    return out


def framed(schema: Schema) -> Schema:
    """schema with the Frame type: header fields, then the payload that the discriminator selects."""
    if found := problems(schema):
        raise SchemaError(found)
    p = schema.protocol
    frame, codes = p.get("frame_type_name", "Frame"), p.get("message_code_type_name", "MessageCode")
    if clash := [n for n in (frame, codes) if n in schema.types]:
        raise SchemaError([f"the schema has a type {n!r} already" for n in clash])
    fields = copy.deepcopy(schema.types[p["header"]]["sequence"])
    by, types = p.get("discriminator"), dict(schema.types)
    if by:
        host = next(f for f in fields if f["name"] == by.split(".")[0])
        if "." not in by and host["type"] in INTEGERS and "const" not in host and "computed" not in host and host["type"].startswith("u") and host["type"] != "uint64":
            types[codes] = {"type": "enum", "repr": host["type"], "open": True, "variants": {m["name"]: message_code(m["code"]) for m in p["messages"]}} | ({"endianness": host["endianness"]} if "endianness" in host else {})
            host["type"] = codes
    if len(p["messages"]) == 1 and not by:
        fields.append({"name": "payload", "type": p["messages"][0]["payload_type"]})
    else:
        fields.append({"name": "payload", "type": "discriminated_union", "discriminator": {"field": by}, "variants": [{"when": f"value == {message_code(m['code'])}", "type": m["payload_type"]} for m in p["messages"]]})
    types[frame] = {"sequence": fields}
    return Schema(types, schema.endianness, schema.bit_order, p, schema.meta)
