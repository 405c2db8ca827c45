"""Where each field of a message lies on the wire."""

from __future__ import annotations

from collections.abc import Callable

from ..schema.model import Schema
from .bits import Reader
from .decode_local import ABSENT, Decoder, Scope


class _Noting(Decoder):
    """A decoder that notes the span of every field it reads."""

    def __init__(self, schema: Schema, root: str):
        self.notes: list[tuple] = []
        self.path: list[str] = []
        super().__init__(schema, root)

    def field(self, f: dict) -> Callable:
        inner, name = super().field(f), f.get("name", f["type"])

        def read(r: Reader, s: Scope) -> object:
            self.path.append(name)
            place = len(self.notes)
            start = 8 * r.at + r.bit
            self.notes.append(None)
            v = inner(r, s)
            end = 8 * r.at + r.bit
            path = ".".join(self.path)
            self.path.pop()
            shown = v[1] if isinstance(v, tuple) else v
            deep = isinstance(shown, dict) or isinstance(shown, list) and shown and isinstance(shown[0], dict)
            self.notes[place] = (start // 8, -(-end // 8) - start // 8, start % 8, end - start, path, f["type"], None if shown is ABSENT or deep else str(shown)) if end > start or shown is not ABSENT else ()
            return v

        return read


def spans(schema: Schema, root: str, data: bytes) -> list[tuple]:
    """(offset, length, bit, bits, path, type, value) of each field, outer ones first."""
    d = _Noting(schema, root)
    d.decode(data)
    return [n for n in d.notes if n]
