"""Encoding of a batch of values at once, in numpy over Arrow arrays.

Each field of the schema becomes a part: the bytes it has in every message of the batch, one after
the other, with their lengths. A composite interleaves the parts of its fields; a list needs no
copying, as the bytes of its items already follow each other.

Computed fields depend on the layout, so a batch with such fields is laid out repeatedly, as the
local codec does it with a message: each pass writes the values computed from the pass before,
until nothing changes. Whatever is out of the ordinary (a missing field, a number out of range, a
text its charset lacks) raises Unsupported, and the local codec encodes the batch message by
message: it knows the exact error or value. So do back references, corresponding<T> selectors and
paths into selected items."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import expr
from ..schema.model import FLOATS, INTEGERS, Schema
from .batch_decode import Unsupported, _truth, ragged, vector
from .bits import Writer
from .decode_local import UINT
from .encode_local import NO_POSITION, PASSES, Encoder


@dataclass
class Part:
    """The bytes of a field in every message: `width` of them each, or as many as `lengths` says."""

    flat: np.ndarray
    n: int
    width: int | None = None
    lengths: np.ndarray | None = None

    def sizes(self) -> np.ndarray:
        return np.full(self.n, self.width, np.int64) if self.lengths is None else self.lengths


def fixed(rows: np.ndarray) -> Part:
    return Part(np.ascontiguousarray(rows).ravel(), len(rows), rows.shape[1])


def joined(parts: list[Part], n: int) -> Part:
    """The parts of each message one behind the other."""
    merged: list[Part] = []
    for p in parts:
        if p.width == 0:
            continue
        if merged and p.width is not None and merged[-1].width is not None:
            a = merged.pop()
            p = fixed(np.concatenate([a.flat.reshape(n, a.width), p.flat.reshape(n, p.width)], axis=1))
        merged.append(p)
    if not merged:
        return Part(np.zeros(0, np.uint8), n, 0)
    if len(merged) == 1:
        return merged[0]
    lengths = sum(p.sizes() for p in merged)
    out = np.empty(int(lengths.sum()), np.uint8)
    at = np.cumsum(lengths) - lengths
    for p in merged:
        if p.width is not None and p.width <= 16:
            rows = p.flat.reshape(n, p.width)
            for k in range(p.width):
                out[at + k] = rows[:, k]
        else:
            out[ragged(at, p.sizes())] = p.flat
        at = at + p.sizes()
    return Part(out, n, None, lengths)


@dataclass
class Items:
    """A list's items as they were laid out: their owners, types and sizes, and where in the list."""

    owner: np.ndarray
    kinds: pa.Array | str
    sizes: np.ndarray
    starts: np.ndarray

    def of(self, kind: str) -> np.ndarray:
        """Which items are of that type."""
        if isinstance(self.kinds, str):
            return np.full(len(self.owner), self.kinds == kind)
        return pc.equal(self.kinds, kind).to_numpy(zero_copy_only=False)


@dataclass
class Frame:
    """A composite of the batch as it was laid out. `index` says which of the parent's messages
    each of its own belongs to."""

    kind: str
    parent: Frame | None
    index: np.ndarray | None
    path: tuple
    n: int
    values: dict = field(default_factory=dict)
    numbers: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)
    items: dict = field(default_factory=dict)

    def starts(self, name: str) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for k, v in self.sizes.items():
            if k == name:
                return out
            out = out + v
        raise Unsupported(name)

    def look(self, path: str) -> tuple:
        here, index = self, None

        def up(f: Frame, index: np.ndarray | None) -> tuple:
            return f.parent, f.index if index is None else index if f.index is None else f.index[index]

        while path.startswith("../"):
            if here is None:
                return None, None
            here, index = up(here, index)
            path = path[3:]
        if path.startswith("_root."):
            while here is not None and here.parent is not None:
                here, index = up(here, index)
            path = path[6:]
        head, *rest = path.split(".")
        while here is not None and head not in here.values:
            here, index = up(here, index)
        if here is None:
            return None, None
        found = here.values[head] if rest or head not in here.numbers else here.numbers[head]
        for p in rest:
            if not isinstance(found, pa.StructArray):
                raise Unsupported(path)
            own = _fields(found)
            if p not in own:
                return None, None
            found = own[p]
        if isinstance(found, pa.StructArray):
            raise Unsupported(path)
        if isinstance(found, pa.Array):
            there = None if not found.null_count else pc.is_valid(found).to_numpy(zero_copy_only=False)
            found = found if pa.types.is_string(found.type) else numbers(pc.fill_null(found, 0) if found.null_count else found)
        else:
            there = None
        if index is not None:
            found = found.take(pa.array(index)) if isinstance(found, pa.Array) else found[index]
            there = None if there is None else there[index]
        return found, there


def _fields(v: pa.StructArray) -> dict[str, pa.Array]:
    return dict(zip([f.name for f in v.type], v.flatten()))


def whole(v: pa.Array) -> pa.Array:
    if v.null_count:
        raise Unsupported("a value is missing")
    return v


def numbers(v: pa.Array) -> np.ndarray:
    """Integers of any Arrow type as int64, or uint64 where they need it."""
    t = whole(v).type
    if pa.types.is_decimal(t):
        if t.scale:
            raise Unsupported("a fraction")
        words = np.frombuffer(v.buffers()[1], np.uint64)[2 * v.offset : 2 * (v.offset + len(v))].reshape(-1, 2) if len(v) else np.zeros((0, 2), np.uint64)
        low, high = words[:, 0], words[:, 1]
        if not high.any():
            return low.view(np.int64) if not (low >> np.uint64(63)).any() else low.copy()
        if (high.view(np.int64) == low.view(np.int64) >> 63).all():
            return low.view(np.int64)
        raise Unsupported("a number of more than 64 bits")
    if pa.types.is_boolean(t):
        return v.cast(pa.int8()).to_numpy().astype(np.int64)
    if not pa.types.is_integer(t):
        raise Unsupported(str(t))
    return v.to_numpy().astype(np.uint64 if t == pa.uint64() else np.int64)


def buffers(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, their lengths) of texts or binaries."""
    whole(v)
    if not len(v):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    large = pa.types.is_large_string(v.type) or pa.types.is_large_binary(v.type)
    at = np.frombuffer(v.buffers()[1], np.int64 if large else np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64)
    raw = v.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, np.diff(at)


class _Pass:
    def __init__(self, known: dict):
        self.known, self.pending = known, {}


class BatchEncoder:
    def __init__(self, schema: Schema, root: str):
        self.schema, self.root = schema, root
        self.msb, self.local, self.constants, self.trees = schema.bit_order == "msb_first", Encoder(schema, root), {}, {}

    def encode(self, values: pa.Array) -> pa.Array:
        known: dict = {}
        for _ in range(PASSES):
            p = _Pass(known)
            part = self.value({"type": self.root}, values, None, None, p, ())
            new = {path: compute() for path, compute in p.pending.items()}
            if all(path in known and np.array_equal(v, known[path]) for path, v in new.items()):
                break
            known = new
        else:
            raise Unsupported("the computed fields do not settle")
        at = np.zeros(part.n + 1, np.int64)
        np.cumsum(part.sizes(), out=at[1:])
        if at[-1] >= 1 << 31:
            raise Unsupported("more than 2 GB in a batch")
        return pa.Array.from_buffers(pa.binary(), part.n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(part.flat)])

    # Types ----------------------------------------------------------------------------------------

    def value(self, f: dict, v: pa.Array | np.ndarray, frame: Frame | None, index: np.ndarray | None, p: _Pass, path: tuple) -> Part:
        """v: an Arrow array, or numbers as they are. index: which of the frame's messages v is for."""
        kind, big = f["type"], self.schema.big(f)
        if kind in INTEGERS:
            size, signed = INTEGERS[kind]
            return self.integer(v if isinstance(v, np.ndarray) else numbers(v), size, big, signed)
        if kind in FLOATS:
            x = whole(v)
            if not pa.types.is_floating(x.type):
                x = x.cast(pa.float64())
            return fixed(x.to_numpy().astype(f"{'>' if big else '<'}f{FLOATS[kind]}").view(np.uint8).reshape(-1, FLOATS[kind]))
        own = self.schema.types.get(kind)
        if own is None:
            return getattr(self, f"_{kind}")(f, v, frame, index, p, path)
        if "sequence" in own:
            return self.composite(kind, own, v, frame, index, p, path)
        if own.get("type") == "enum":
            return self.integer(self.codes(own, v), UINT[own["repr"]], self.schema.big(own), False)
        return self.value(own, v, frame, index, p, path)

    def codes(self, own: dict, v: pa.Array) -> np.ndarray:
        names = list(own["variants"])
        at = whole(pc.index_in(whole(v), pa.array(names)))
        return np.array([own["variants"][n] for n in names], np.int64)[at.to_numpy()]

    def composite(self, name: str, spec: dict, v: pa.Array, parent: Frame | None, index: np.ndarray | None, p: _Pass, path: tuple) -> Part:
        if not isinstance(v, pa.StructArray):
            raise Unsupported("a composite that is no struct")
        if len(path) > 64:
            raise Unsupported("composites are nested deeply")
        n, given = len(v), _fields(v)
        frame = Frame(name, parent, index, path, n)
        frame.values = {k: x for k, x in given.items() if not x.null_count or x.null_count < n}
        parts: list[Part] = []
        held: list[tuple[np.ndarray, int]] = []
        for f in spec["sequence"]:
            key = f.get("name")
            if "computed" in f and key in given and given[key].null_count < n:
                raise Unsupported("a computed field is given")
            if f["type"] in ("bit", "bitfield", "int") and "conditional" not in f and "computed" not in f:
                held += self.run(f, given.get(key), n)
                frame.values[key] = given.get(key, held[-1][0])
                frame.sizes[key] = np.zeros(n, np.int64)
                if sum(b for _, b in held) % 8 == 0:
                    parts.append(self.packed(held))
                    frame.sizes[key] = parts[-1].sizes()
                    held = []
                continue
            if held:
                raise Unsupported("bytes off a byte boundary")
            if f["type"] == "padding":
                size = sum((x.sizes() for x in parts), np.zeros(n, np.int64))
                if path:
                    raise Unsupported("padding in a composite within another")
                lengths = -size % f["align_to"]
                parts.append(Part(np.zeros(int(lengths.sum()), np.uint8), n, None, lengths))
                frame.sizes["padding", len(parts)] = lengths
                continue
            parts.append(self.field(f, given.get(key), frame, p))
            frame.sizes[key] = parts[-1].sizes()
        if held:
            total = sum(b for _, b in held)
            held.append((np.zeros(n, np.int64), -total % 8))
            parts.append(self.packed(held))
        return joined(parts, n)

    def field(self, f: dict, v: pa.Array | None, frame: Frame, p: _Pass) -> Part:
        if "conditional" not in f:
            return self.present(f, v, frame, None, p)
        if f["conditional"] not in self.trees:
            self.trees[f["conditional"]] = expr.parse(f["conditional"])
        x, ok = vector(self.trees[f["conditional"]], frame.look)
        index = np.flatnonzero(np.broadcast_to(np.logical_and(_truth(x), ok), frame.n))
        if len(index) == frame.n:
            return self.present(f, v, frame, None, p)
        if "computed" in f:
            raise Unsupported("a computed field under a condition")
        part = self.present(f, None if v is None else v.take(pa.array(index)), frame, index, p) if len(index) else Part(np.zeros(0, np.uint8), 0, 0)
        return widened(part, index, frame.n)

    def present(self, f: dict, v: pa.Array | None, frame: Frame, index: np.ndarray | None, p: _Pass) -> Part:
        n = frame.n if index is None else len(index)
        path = (*frame.path, f["name"])
        if "computed" in f:
            known = p.known.get(path)
            x = np.zeros(n, np.int64) if known is None else known
            frame.values[f["name"]] = x
            p.pending[path] = self.computed(f, frame)
            return self.value(f, x, frame, index, p, path)
        if "const" in f:
            raw = self.constant(f)
            frame.values[f["name"]] = pa.array([f["const"]] * frame.n) if isinstance(f["const"], str) else np.full(frame.n, f["const"], np.int64) if isinstance(f["const"], int) and abs(f["const"]) < 1 << 63 else pa.nulls(frame.n)
            return Part(np.tile(np.frombuffer(raw, np.uint8), n), n, len(raw))
        own = self.schema.types.get(f["type"], {})
        if own.get("type") == "enum" and v is not None and index is None:
            frame.numbers[f["name"]] = self.codes(own, v)
        if v is None:
            if f["type"] != "optional":
                raise Unsupported("a field is missing")
            return fixed(np.zeros((n, 1), np.uint8)) if f.get("presence_type") != "bit" else self.value(f, pa.nulls(n), frame, index, p, path)
        return self.value(f, v, frame, index, p, path)

    def constant(self, f: dict) -> bytes:
        key = id(f)
        if key not in self.constants:
            w = Writer(self.msb)
            self.local.element(f)(w, f["const"], None, None, ())
            w.finish()
            self.constants[key] = f, bytes(w.out)
        return self.constants[key][1]

    # Elements -----------------------------------------------------------------------------------

    def integer(self, x: np.ndarray, size: int, big: bool, signed: bool) -> Part:
        if x.dtype == np.uint64:
            if size < 8 or signed:
                raise Unsupported("a number out of range")
        elif len(x):
            low, high = (-(1 << 8 * size - 1), (1 << 8 * size - 1) - 1) if signed else (0, (1 << 8 * size) - 1)
            if x.min() < low or x.max() > high:
                raise Unsupported("a number out of range")
        return fixed(x.astype(f"{'>' if big else '<'}{'i' if signed else 'u'}{size}").view(np.uint8).reshape(-1, size))

    def run(self, f: dict, v: pa.Array | None, n: int) -> list[tuple[np.ndarray, int]]:
        if f["type"] == "bitfield":
            own = _fields(whole(v)) if isinstance(v, pa.StructArray) else {}
            if not own:
                raise Unsupported("a bit field is missing")
            return [(self.ranged(own[x["name"]], x["size"], False) if x["name"] in own else np.zeros(n, np.int64), x["size"]) for x in f["fields"]]
        size = f.get("size", 1)
        if "const" in f:
            return [(np.full(n, f["const"], np.int64), size)]
        if v is None:
            raise Unsupported("a field is missing")
        return [(self.ranged(v, size, f["type"] == "int"), size)]

    def ranged(self, v: pa.Array, size: int, signed: bool) -> np.ndarray:
        x = numbers(v)
        if size > 56 or x.dtype == np.uint64:
            raise Unsupported("many bits")
        low, high = (-(1 << size - 1), (1 << size - 1) - 1) if signed else (0, (1 << size) - 1)
        if len(x) and (x.min() < low or x.max() > high):
            raise Unsupported("a number out of range")
        return x & (1 << size) - 1

    def packed(self, held: list[tuple[np.ndarray, int]]) -> Part:
        total, n = sum(b for _, b in held), len(held[0][0])
        out = np.zeros((n, total // 8), np.uint8)
        at = 0
        for x, size in held:
            done = 0
            while done < size:
                k = min(size - done, 8 - at % 8)
                if self.msb:
                    out[:, at // 8] |= ((x >> (size - done - k) & (1 << k) - 1) << (8 - at % 8 - k)).astype(np.uint8)
                else:
                    out[:, at // 8] |= ((x >> done & (1 << k) - 1) << at % 8).astype(np.uint8)
                done, at = done + k, at + k
        return fixed(out)

    def _bool(self, f, v, *_) -> Part:
        if not pa.types.is_boolean(whole(v).type):
            raise Unsupported("a truth value that is none")
        return fixed(v.cast(pa.uint8()).to_numpy().reshape(-1, 1))

    def _varlength(self, f, v, *_) -> Part:
        return self.varint(v if isinstance(v, np.ndarray) else numbers(v), f["encoding"])

    def varint(self, x: np.ndarray, kind: str) -> Part:
        if x.dtype != np.uint64 and len(x) and x.min() < 0:
            raise Unsupported("a negative number")
        x = x.astype(np.uint64)
        n, bits = len(x), np.zeros(len(x), np.int64)
        for k in range(64):
            bits += (x >> np.uint64(k)) > 0
            if not bits.max(initial=0) > k:
                break
        groups = np.maximum(-(-bits // 7), 1)
        if kind == "der":
            more = np.maximum(-(-bits // 8), 1)
            lengths = np.where(x < 128, 1, more + 1)
        elif kind == "ebml":
            lengths = np.ones(n, np.int64)
            for k in range(1, 9):
                lengths += x >= np.uint64((1 << 7 * k) - 1)
            if lengths.max(initial=0) > 8:
                raise Unsupported("a number out of range")
        else:
            lengths = groups
            if kind == "vlq" and groups.max(initial=0) > 4:
                raise Unsupported("a number out of range")
        width = int(lengths.max(initial=1))
        rows = np.zeros((n, width), np.uint8)
        for k in range(width):
            on = lengths > k
            back = np.maximum(lengths - 1 - k, 0)
            if kind == "leb128":
                byte = x >> np.uint64(min(7 * k, 63)) & np.uint64(127) | np.where(back > 0, 128, 0).astype(np.uint64)
            elif kind == "vlq":
                byte = x >> (7 * back).astype(np.uint64) & np.uint64(127) | np.where(back > 0, 128, 0).astype(np.uint64)
            else:
                byte = np.where(8 * back < 64, x >> np.minimum(8 * back, 63).astype(np.uint64) & np.uint64(255), 0)
                if kind == "der" and k == 0:
                    byte = np.where(lengths == 1, x, (128 | lengths - 1).astype(np.uint64))
                elif kind == "ebml" and k == 0:
                    byte = byte | (1 << 8 - lengths).astype(np.uint64)
            rows[:, k] = np.where(on, byte & np.uint64(255), 0).astype(np.uint8)
        return Part(rows[np.arange(width) < lengths[:, None]], n, None, lengths)

    def _optional(self, f, v, frame, index, p, path) -> Part:
        if f.get("presence_type") == "bit":
            raise Unsupported("a presence bit")
        value = f["value_type"]
        inner = {**{k: x for k, x in f.items() if k == "endianness"}, **(value if isinstance(value, dict) else {"type": value})}
        there = pc.is_valid(v).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(there)
        head = fixed(there.astype(np.uint8).reshape(-1, 1))
        if not len(own):
            return head
        part = self.value(inner, v.take(pa.array(own)) if len(own) < len(v) else v, frame, own if index is None else index[own], p, path)
        return joined([head, widened(part, own, len(v))], len(v))

    def prefix(self, f: dict, x: np.ndarray) -> Part:
        if f.get("length_type") == "varlength":
            return self.varint(x, f.get("length_encoding", "der"))
        return self.integer(x, UINT[f.get("length_type", "uint8")], self.schema.big(f), False)

    def text(self, v: pa.Array, f: dict) -> tuple[np.ndarray, np.ndarray]:
        encoding = f.get("encoding", "utf8")
        if not (pa.types.is_string(v.type) or pa.types.is_large_string(v.type)):
            raise Unsupported("a text that is none")
        flat, n = buffers(v)
        if encoding == "utf8":
            return flat, n
        if encoding in ("ascii", "latin1"):
            if not len(flat) or flat.max() < 128:
                return flat, n
            if encoding == "ascii":
                raise Unsupported("a text that is not ASCII")
            try:
                raw = flat.tobytes().decode().encode("latin-1")
            except UnicodeEncodeError:
                raise Unsupported("a text that is not Latin-1") from None
            return np.frombuffer(raw, np.uint8), n - self.within(flat & 0xC0 == 0x80, n)
        lead = self.within((flat & 0xC0 != 0x80).astype(np.int64) + (flat >= 0xF0), n)
        raw = flat.tobytes().decode().encode("utf-16-be" if self.schema.big(f) else "utf-16-le")
        return np.frombuffer(raw, np.uint8), 2 * lead

    @staticmethod
    def within(x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Sums of x over spans of n."""
        sums = np.zeros(len(x) + 1, np.int64)
        np.cumsum(x, out=sums[1:])
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]

    def _string(self, f, v, frame, index, p, path) -> Part:
        flat, n = self.text(v, f)
        kind, rows = f.get("kind", "fixed"), len(v)
        if kind == "fixed":
            return self.sized(flat, n, f["length"])
        body = Part(flat, rows, None, n)
        if kind == "length_prefixed":
            return joined([self.prefix(f, n), body], rows)
        if kind == "null_terminated":
            return joined([body, fixed(np.zeros((rows, 2 if f.get("encoding") == "utf16" else 1), np.uint8))], rows)
        return body

    def sized(self, flat: np.ndarray, n: np.ndarray, width: int) -> Part:
        """Cut or filled with zeros to one width."""
        out = np.zeros((len(n), width), np.uint8)
        starts, kept = np.cumsum(n) - n, np.minimum(n, width)
        out[np.arange(width) < kept[:, None]] = flat[ragged(starts, kept)]
        return fixed(out)

    def _bytes(self, f, v, frame, index, p, path) -> Part:
        f = {**f, "kind": f.get("kind", "fixed")}
        if not (pa.types.is_binary(whole(v).type) or pa.types.is_large_binary(v.type)):
            return self._array({**f, "items": {"type": "uint8"}}, v, frame, index, p, path)
        flat, n = buffers(v)
        body = Part(flat, len(v), None, n)
        if f["kind"] == "fixed" and (n != f["length"]).any():
            raise Unsupported("bytes of another length")
        if f["kind"] in ("length_prefixed", "byte_length_prefixed"):
            return joined([self.prefix(f, n), body], len(v))
        if f["kind"] == "null_terminated":
            return joined([body, fixed(np.zeros((len(v), 1), np.uint8))], len(v))
        if f["kind"] == "length_prefixed_items":
            raise Unsupported("bytes with prefixes")
        return body

    def _array(self, f, v, frame, index, p, path) -> Part:
        kind, items, rows = f["kind"], f["items"], len(v)
        if not (pa.types.is_list(whole(v).type) or pa.types.is_large_list(v.type)):
            raise Unsupported("a list that is none")
        at = v.offsets.to_numpy().astype(np.int64)
        n, flat = np.diff(at), v.flatten()
        if kind == "fixed" and (n != f["length"]).any():
            raise Unsupported("a fixed array of another length")
        owner = np.repeat(np.arange(rows) if index is None else index, n)
        part = self.value(items, flat, frame, owner, p, (*path, "[]"))
        sizes = part.sizes()
        if kind == "length_prefixed_items":
            part = joined([self.integer(sizes, UINT[f.get("item_length_type", "uint32")], self.schema.big(f), False), part], len(flat))
        step = part.sizes()
        ends = np.cumsum(step)
        lengths = self.within(step, n)
        body = Part(part.flat, rows, None, lengths)
        head = None
        if kind in ("length_prefixed", "length_prefixed_items"):
            head = self.prefix(f, n)
        elif kind == "byte_length_prefixed":
            head = self.prefix(f, lengths)
        if frame is not None and index is None and path == (*frame.path, f.get("name")):
            own = np.repeat(np.arange(rows), n)
            before = ends - step - np.repeat(np.cumsum(lengths) - lengths, n) + (step - sizes)
            if head is not None:
                before = before + head.sizes()[own]
            kinds = self.schema.types.get(items["type"], items)
            tagged = items if items["type"] in ("choice", "discriminated_union") else kinds if kinds.get("type") in ("choice", "discriminated_union") else None
            names = _fields(flat)["type"] if tagged is not None and len(flat) else items["type"]
            frame.items[f["name"]] = Items(own, names, sizes, before)
        out = [body] if head is None else [head, body]
        if kind == "null_terminated":
            terminal = f.get("terminal_variants") or []
            stop = np.ones(rows, np.int64)
            if terminal and len(flat):
                ended = pc.is_in(_fields(flat)["type"], pa.array(terminal)).to_numpy(zero_copy_only=False)
                stop[n > 0] = ~ended[at[1:][n > 0] - at[0] - 1]
            out.append(Part(np.zeros(int(stop.sum()), np.uint8), rows, None, stop))
        return joined(out, rows)

    # Variants --------------------------------------------------------------------------------------

    def _discriminated_union(self, f, v, frame, index, p, path) -> Part:
        return self.variants([x["type"] for x in f["variants"]], v, frame, index, p, path)

    def _choice(self, f, v, frame, index, p, path) -> Part:
        return self.variants([x["type"] for x in f["choices"]], v, frame, index, p, path)

    def variants(self, names: list[str], v: pa.Array, frame, index, p, path) -> Part:
        if not isinstance(v, pa.StructArray):
            raise Unsupported("a variant that is no struct")
        given = _fields(v)
        which = pc.index_in(whole(given["type"]), pa.array(names))
        which = whole(which).to_numpy()
        parts = []
        for k, name in enumerate(names):
            own = np.flatnonzero(which == k)
            if not len(own):
                continue
            if name not in given:
                raise Unsupported("a variant without its field")
            x = given[name] if len(own) == len(v) else given[name].take(pa.array(own))
            part = self.value({"type": name}, x, frame, own if index is None else index[own], p, (*path, name))
            parts.append(widened(part, own, len(v)))
        return joined(parts, len(v))

    def _back_reference(self, *_) -> Part:
        raise Unsupported("back references")

    # Computed fields ---------------------------------------------------------------------------------

    def computed(self, f: dict, frame: Frame):
        """A function that computes the field once the batch is laid out."""
        c = f["computed"]
        kind, extra = c["type"], c.get("offset", 0)

        def run() -> np.ndarray:
            if "from_after_field" in c:
                if c["from_after_field"] not in frame.sizes:
                    raise Unsupported("a field that isn't there")
                names = list(frame.sizes)
                return sum((frame.sizes[k] for k in names[names.index(c["from_after_field"]) + 1 :]), np.zeros(frame.n, np.int64)) + extra
            if kind == "sum_of_sizes":
                total = np.zeros(frame.n, np.int64)
                for t in c["targets"]:
                    home, index, name = self.home(frame, t)
                    if name not in home.sizes:
                        raise Unsupported(t)
                    total = total + (home.sizes[name] if index is None else home.sizes[name][index])
                return total + extra
            home, index, name = self.home(frame, c["target"])
            at = (lambda x: x) if index is None else (lambda x: x[index])
            if kind == "sum_of_type_sizes":
                if name not in home.items:
                    raise Unsupported(c["target"])
                items = home.items[name]
                return at(np.bincount(items.owner, np.where(items.of(c["element_type"]), items.sizes, 0), home.n).astype(np.int64)) + extra
            if "[" in name:
                return at(self.selected(home, name, kind, extra))
            if name not in home.sizes:
                raise Unsupported(c["target"])
            if kind == "position_of":
                return at(home.starts(name)) + extra
            v = home.values.get(name)
            if kind == "crc32_of":
                return at(self.sums(v))
            if isinstance(v, np.ndarray):
                return at(v) + extra
            if v is None or v.null_count:
                raise Unsupported("a target that is missing")
            if pa.types.is_string(v.type) or pa.types.is_large_string(v.type):
                spec = next(x for x in self.schema.types[home.kind]["sequence"] if x.get("name") == name)
                return at(self.text(v, {**spec, "encoding": c["encoding"]} if "encoding" in c else {"encoding": "utf16"})[1] // (1 if "encoding" in c else 2)) + extra
            if pa.types.is_binary(v.type):
                return at(buffers(v)[1]) + extra
            if pa.types.is_list(v.type):
                return at(np.diff(v.offsets.to_numpy()).astype(np.int64)) + extra
            return at(home.sizes[name] if pa.types.is_struct(v.type) else numbers(v)) + extra

        return run

    def sums(self, v) -> np.ndarray:
        if not isinstance(v, pa.Array) or v.null_count or not (pa.types.is_binary(v.type) or pa.types.is_list(v.type)):
            raise Unsupported("a CRC of no bytes")
        flat, n = buffers(v) if pa.types.is_binary(v.type) else (numbers(v.flatten()).astype(np.uint8), np.diff(v.offsets.to_numpy()).astype(np.int64))
        ends = np.cumsum(n)
        return np.array([zlib.crc32(flat[b:e]) for b, e in zip((ends - n).tolist(), ends.tolist())], np.int64)

    def home(self, frame: Frame, path: str) -> tuple[Frame, np.ndarray | None, str]:
        """The composite that holds a target, which of its messages each of the frame's belongs to,
        and the rest of the path."""
        here, index = frame, None

        def up() -> None:
            nonlocal here, index
            index = here.index if index is None else index if here.index is None else here.index[index]
            here = here.parent
            if here is None:
                raise Unsupported("a path above the root")

        while path.startswith("../"):
            up()
            path = path[3:]
        name = path.partition(".")[0].partition("[")[0]
        if "." in path:
            raise Unsupported("a path into a field")
        while name not in here.sizes and here.parent is not None:
            up()
        return here, index, path

    def selected(self, home: Frame, name: str, kind: str, extra: int) -> np.ndarray:
        name, _, selector = name.rstrip("]").partition("[")
        how, _, wanted = selector.rstrip(">").partition("<")
        if how not in ("first", "last") or kind not in ("position_of", "length_of") or name not in home.items:
            raise Unsupported(selector)
        items = home.items[name]
        own = np.flatnonzero(items.of(wanted))
        out = np.full(home.n, NO_POSITION if kind == "position_of" else extra, np.int64)
        ordered = own[::-1] if how == "first" else own  # the last assignment stays
        if kind == "position_of":
            out[items.owner[ordered]] = (home.starts(name)[items.owner] + items.starts)[ordered] + extra
        else:
            raise Unsupported("the length of a selected item")
        return out


def widened(part: Part, index: np.ndarray, n: int) -> Part:
    """A part of some messages as one of all: the others have no bytes."""
    if len(index) == n:
        return part
    lengths = np.zeros(n, np.int64)
    lengths[index] = part.sizes()
    return Part(part.flat, n, None, lengths)
