"""Removal of repeated passages by a blockwise suffix sort with a difference cover.

Wanted are all suffixes (starts of `length`-byte strings) whose first `length` bytes occur anywhere
else. Suffixes are dealt to buckets, and one bucket is sorted at a time:

1. Filter. A difference cover D modulo v has, for any two positions p and q, a shift k < v with
   p + k and q + k both in D (mod v). Positions in D are sampled, each named by a hash of its next
   length - v + 1 bytes. If the strings at p and q are equal, the samples at p + k are, so a suffix
   is a candidate only if, within v bytes, a sample has a name that occurs twice. Equal strings
   have equal hashes, so the filter loses nothing; what it lets through is compared in full.
2. Buckets. A suffix belongs to the bucket of its anchor: of the short windows of its `length`
   bytes that with the least hash, the first on a tie. Equal strings have equal anchors at equal
   places. Neighbouring suffixes mostly share an anchor and travel as one segment of text, of some
   hundreds of bytes; a segment that occurs in several places (by its 128-bit BLAKE2 hash) travels
   once and is known to be repeated.
3. Sort. In each bucket the sample of a small cover (v = 13) is ranked in text order by prefix
   doubling: names of 13 bytes, then of 26, 52, 104, 208 and 377, as the cover's period keeps p + h
   in the sample. Suffixes are then sorted by their first 13 bytes, ties by the ranks of the
   sample at the shift that the cover has for their residues, and by their last bytes. No hash
   decides here. Memory holds a bucket, in a few numbers a byte.

An anchor that more than HOT_BYTES of different segments share is no bucket: its suffixes are
exploded and grouped by their bytes in Spark, so no task holds an unbounded group. Texts are stored
in blocks of whole documents, and all positions are positions in a block. A block sends two
occurrences of a sample at most, so one that is in very many places meets as two for each block.

Defined results: a null text counts as empty; a text shorter than `length` keeps all its bytes;
matches never cross documents; overlapping strings of one document count; repeated rows repeat
each other and are removed, both; an empty table gives an empty result; extra columns are ignored.
Cutting whole bytes may split a character: `kept` is bytes, and `kept_text` decodes with U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, width

LENGTH = 400
COVER_R = 2  # of the cover's construction
BLOCK_BYTES, TILE = 1 << 20, 1 << 19
NAME_BYTES = 16 << 20  # of packed sample names that a task sorts at once
ANCHOR = 32  # bytes of the windows that anchors are chosen from
BUCKET_BYTES, HOT_BYTES = 2 << 20, 8 << 20  # of segments that are sorted at once; of an anchor that is no bucket
TASK_BYTES = 2 << 20  # of segments that a task gets
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # an odd multiplier


def cover(r: int = COVER_R) -> tuple[int, list[int]]:
    """(v, D) after Colbourn and Ling: prefix sums of a fixed pattern of steps."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    v = 24 * r * r + 36 * r + 13
    return v, sorted({x % v for x in np.r_[0, np.cumsum(steps)].tolist()})


class Hasher:
    """Rolling hashes of all windows of a size, by prefix sums modulo 2^64."""

    def __init__(self):
        base = BASE
        rng = np.random.default_rng(1234)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = TILE + 4 * LENGTH
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def windows(self, data: np.ndarray, size: int) -> np.ndarray:
        """Of each start; data has at most TILE + size - 1 bytes."""
        n = len(data)
        if n < size:
            return np.zeros(0, np.uint64)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * self.down[: n - size + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


@functools.cache
def hasher() -> Hasher:
    return Hasher()


def _tiles(data: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, max(len(data) - size + 1, 0), TILE):
        yield at, data[at : at + TILE + size - 1]


def pack(parts: list[np.ndarray], at: np.ndarray) -> bytes:
    """Arrays of one length and their increasing positions, as bytes."""
    gaps = np.diff(at, prepend=0)
    narrow = len(gaps) == 0 or int(gaps.max()) < 1 << 16
    return len(at).to_bytes(4, "little") + bytes([narrow]) + gaps.astype("<u2" if narrow else "<u4").tobytes() + b"".join([p.tobytes() for p in parts])


def unpack(blob: bytes, kinds: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    n, narrow, i, out = int.from_bytes(blob[:4], "little"), blob[4], 5, []
    for kind in ["<u2" if narrow else "<u4", *kinds]:
        out.append(np.frombuffer(blob, kind, n, i))
        i += n * np.dtype(kind).itemsize
    return out[1:], np.cumsum(out[0], dtype=np.int64)


def _list(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """One list of all parts."""
    flat = pa.concat_arrays(parts) if parts else pa.array([], kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def blocks(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The stored texts: block, ends (of each text within data), data (compressed), and `rest`, the
    carried columns of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rest, texts, size, first = [], [], 0, 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64).tolist()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([_zipped(b"".join(texts))], pa.binary()), _list(rest, rest[0].type)], ["block", "ends", "data", "rest"])

        for batch in batches:
            first = 0
            for i, t in enumerate(batch.column(0)):
                texts.append((t.as_py() or "").encode())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    rest.append(batch.column(1).slice(first, i + 1 - first))
                    yield row()
                    number, rest, texts, size, first = number + 1, [], [], 0, i + 1
            if first < batch.num_rows:
                rest.append(batch.column(1).slice(first))
        if texts:
            yield row()

    src = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest"))
    kind = src.schema["rest"].dataType.simpleString()
    return stored(src.mapInArrow(run, f"block long, ends array<bigint>, data binary, rest array<{kind}>"), "texts")


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def _dealt(block: int, bucket: np.ndarray, parts: list[np.ndarray], at: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that the block has something for."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    begins = np.flatnonzero(np.diff(sorted_, prepend=-1))
    own = [order[b:e] for b, e in zip(begins, [*begins[1:], len(order)])]
    blobs = [pack([p[x] for p in parts], at[x]) for x in own]
    return pa.RecordBatch.from_arrays([pa.array(sorted_[begins], pa.int32()), pa.array([block] * len(own), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "packed"])


def _one_bucket_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """Rows sorted by bucket, as lists of (block, packed), a bucket each."""
    now, rows = None, []
    for batch in batches:
        for bucket, block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if bucket != now and rows:
                yield rows
                rows = []
            now = bucket
            rows.append((block, blob))
    if rows:
        yield rows


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order] = np.r_[False, same] | np.r_[same, False]
    return out


def _starts(ends: np.ndarray, total: int, size: int) -> np.ndarray:
    """Which positions start a string of that size within their document."""
    ok = np.zeros(total + 1, np.int32)
    begins = np.r_[0, ends[:-1]]
    last = ends - size + 1
    fits = last > begins
    np.add.at(ok, begins[fits], 1)
    np.add.at(ok, last[fits], -1)
    return np.cumsum(ok)[:total] > 0


def _zipped(raw: bytes) -> bytes:
    """Texts are stored and moved compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzipped(batch: pa.RecordBatch, i: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(batch.column("data")[i].as_buffer())


def _row(batch: pa.RecordBatch, i: int, *names: str) -> list:
    return [np.array(batch.column(n)[i].as_py(), np.int64) if n == "ends" else np.frombuffer(_unzipped(batch, i), np.uint8) if n == "data" else batch.column(n)[i].as_py() for n in names]


def _first_two(keys: np.ndarray) -> np.ndarray:
    """Increasing indices of the first two of each key: all that other blocks need to know of a block."""
    if len(keys) < 3:
        return np.arange(len(keys))
    order = np.argsort(keys, kind="stable")
    return np.sort(order[np.r_[True, True, keys[order[2:]] != keys[order[:-2]]]])


def _sampled(ends: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """48-bit names and positions of a block's cover samples."""
    v, d = cover()
    size, h = length - v + 1, hasher()
    begins = np.repeat(np.r_[0, ends[:-1]], np.diff(ends, prepend=0)) if len(data) else np.zeros(0, np.int64)
    picked = _starts(ends, len(data), size) & np.isin(np.arange(v), d)[(np.arange(len(data)) - begins) % v]
    keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, tile in _tiles(data, size):
        own = np.flatnonzero(picked[lo : lo + len(tile) - size + 1])
        k = h.windows(tile, size)[own]
        keys.append(k & np.uint64(0xFFFFFFFF) | k >> np.uint64(48) << np.uint64(32))
        at.append(own + lo)
    return np.concatenate(keys), np.concatenate(at)


def _samples(length: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, ends, data = _row(batch, i, "block", "ends", "data")
                k, at = _sampled(ends, data, length)
                own = _first_two(k)
                k, at = k[own], at[own]
                if len(at):
                    yield _dealt(block, _buckets(k, n), [(k & np.uint64(0xFFFFFFFF)).astype("<u4"), (k >> np.uint64(32)).astype("<u2")], at)

    return run


def _repeated_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _one_bucket_at_a_time(batches):
        parts = [unpack(b, ["<u4", "<u2"]) for _, b in rows]
        keys = np.concatenate([p[0].astype(np.uint64) | p[1].astype(np.uint64) << np.uint64(32) for p, _ in parts])
        yield _returned(rows, [at for _, at in parts], _twice(keys))


def _returned(rows: list[tuple[int, bytes]], places: list[np.ndarray], flags: np.ndarray) -> pa.RecordBatch:
    """The flagged positions, back to their blocks."""
    names, blobs, i = [], [], 0
    for (block, _), at in zip(rows, places):
        own = at[flags[i : i + len(at)]]
        i += len(at)
        if len(own):
            names.append(block)
            blobs.append(pack([], own))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["block", "packed"])


def _positions(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([unpack(b, [])[1] for b in blobs]) if blobs else np.zeros(0, np.int64)


def _candidates(length: int):
    """Splits each block: documents with a candidate, which are sorted, and the others (o_)."""
    v, _ = cover()

    def part(ends: np.ndarray, data: np.ndarray, own: np.ndarray, rest: pa.Array) -> list[pa.Array]:
        begins = np.r_[0, ends[:-1]]
        texts = b"".join([data[begins[k] : ends[k]].tobytes() for k in own])
        return [pa.array([np.cumsum(ends[own] - begins[own]).tolist()], pa.list_(pa.int64())), pa.array([_zipped(texts)], pa.binary()), _list([rest.take(pa.array(own))], rest.type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, ends, data, blobs = _row(batch, i, "block", "ends", "data", "packed")
                rest = batch.column("rest")[i].values
                near = np.zeros(len(data) + 1, np.int32)
                at = _positions(blobs or [])
                if len(at):  # with them all samples of the block that have their names
                    k, all_ = _sampled(ends, data, length)
                    at = all_[np.isin(k, k[np.searchsorted(all_, at)])]
                np.add.at(near, np.maximum(at - v + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                mask = (np.cumsum(near)[:-1] > 0) & _starts(ends, len(data), length)
                marked = np.r_[0, np.cumsum(mask)]
                begins = np.r_[0, ends[:-1]]
                has = marked[ends] > marked[begins]
                own = np.flatnonzero(has)
                bits = np.packbits(np.concatenate([mask[begins[k] : ends[k]] for k in own])) if len(own) else np.zeros(0, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *part(ends, data, own, rest), pa.array([bits.tobytes()], pa.binary()), pa.array([int(mask.sum())], pa.int64()), *part(ends, data, np.flatnonzero(~has), rest)], ["block", "ends", "data", "rest", "mask", "n", "o_ends", "o_data", "o_rest"])

    return run


def _mask(batch: pa.RecordBatch, i: int, total: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(batch.column("mask")[i].as_buffer(), np.uint8), count=total).astype(bool)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n in a row."""
    size = len(x) - n + 1
    rows = -(-len(x) // n)
    padded = np.full(rows * n, MASK, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, n)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:size], ahead[n - 1 : n - 1 + size])


def _runs(data: np.ndarray, mask: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first suffix, number of suffixes, anchor's hash) of the runs of marked suffixes with one
    anchor. The hash has 40 bits."""
    first, count, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, tile in _tiles(data, length):
        n = len(tile) - length + 1
        own = mask[lo : lo + n]
        if not own.any():
            continue
        h = hasher().windows(tile, ANCHOR)
        least = _least(h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64), length - ANCHOR + 1)
        begins = own & (np.r_[True, ~own[:-1]] | np.r_[True, least[1:] != least[:-1]])
        at = np.flatnonzero(begins)
        ends = np.flatnonzero(own & (np.r_[~own[1:], True] | np.r_[least[1:] != least[:-1], True]))
        first.append(at + lo)
        count.append(ends - at + 1)
        anchors.append((least[at] >> np.uint64(24)).astype(np.int64))
    return np.concatenate(first), np.concatenate(count), np.concatenate(anchors)


def _named(data: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> list[bytes]:
    """The segments' names."""
    raw = data.tobytes()
    return [hashlib.blake2b(raw[a : a + n + length - 1], digest_size=16).digest() for a, n in zip(first.tolist(), count.tolist())]


def _segments(length: int):
    """A row for each different segment of a block; `many` if the block has it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, data = _row(batch, i, "block", "data")
                first, count, anchors = _runs(data, _mask(batch, i, len(data)), length)
                seen: dict[bytes, list] = {}
                for name, a, n, g in zip(_named(data, first, count, length), first.tolist(), count.tolist(), anchors.tolist()):
                    if name in seen:
                        seen[name][3] = True
                    else:
                        seen[name] = [g, a, n + length - 1, False]
                rows = list(seen.items())
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    texts = pa.array([data[a : a + n].tobytes() for _, (_, a, n, _) in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array([r[0] for _, r in part], pa.int64()), pa.array([name for name, _ in part], pa.binary()), texts, pa.array([r[3] for _, r in part])], ["block", "anchor", "name", "segment", "many"])

    return run


SMALL_V, SMALL_D = 13, (0, 1, 4, 6)  # a perfect difference set: the differences modulo 13 are all there


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of unsigned keys, in their order."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), np.uint64)
    new[0:1] = 0
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(new)
    return out


def _word(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n bytes from each place as a number whose order is that of the bytes."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def _ranked(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Ranks in text order of the n bytes from each place; fewer than 2**24 places."""
    out = _ranks(_word(data, at, min(n, 8)))
    for k in range(8, n, 5):
        size = min(5, n - k)
        out = _ranks(out << np.uint64(8 * size) | _word(data, at + k, size))
    return out


def repeated(data: np.ndarray, at: np.ndarray, length: int, known: np.ndarray) -> np.ndarray:
    """Which of the suffixes at `at` have an equal one among them (or are known to), by sorting them."""
    v, d = SMALL_V, np.isin(np.arange(SMALL_V), SMALL_D)
    data = np.concatenate([data, np.zeros(2 * length, np.uint8)])
    sample = np.flatnonzero(d[np.arange(len(data) - length) % v])
    place = np.zeros(len(data), np.int64)  # of each position in the sample
    place[sample] = np.arange(len(sample))
    inner = length - 2 * v + 3  # so much a sample's rank must tell, and no more than the string has behind any shift
    rank, h = _ranked(data, sample, v), v
    while h < inner:
        step = h if 2 * h <= inner else (inner - h) // v * v
        if step == 0:
            break
        later = np.minimum(sample + step, len(data) - length - 1)
        later -= (later - sample) % v  # the period keeps it in the sample
        rank = _ranks(rank << np.uint64(32) | rank[place[later]])
        h += step
    rest = length - h  # the last bytes: those that a rank at shift 0 does not tell
    head, tail = _ranked(data, at, v), _ranked(data, at + length - rest, rest)
    ends = _ranks(head << np.uint64(32) | tail)
    out = known.copy()
    for shift in range(v):
        own = np.flatnonzero(d[(at + shift) % v])
        if len(own) < 2:
            continue
        keys = ends[own] << np.uint64(32) | rank[place[at[own] + shift]]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out[own[order]] |= np.r_[False, same] | np.r_[same, False]
    return out


def _sorted_buckets(length: int):
    """Over segments by anchor: the repeated suffixes of each, as places in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[bytes] = []
        texts: list[bytes] = []
        many: list[bool] = []
        size, now, cut = 0, None, 0

        def bucket(k: int) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts[:k]], np.int64)
            begins, n = np.cumsum(lengths) - lengths, lengths - length + 1
            owner = np.repeat(np.arange(k), n)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            found = repeated(np.frombuffer(b"".join(texts[:k]), np.uint8), begins[owner] + within, length, np.array(many[:k])[owner])
            flat, sizes = within[found].astype(np.int32), np.bincount(owner[found], minlength=k)
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
            return pa.RecordBatch.from_arrays([pa.array(names[:k], pa.binary()), places], ["name", "places"]).filter(pa.array(sizes > 0))

        for batch in batches:
            for anchor, name, text, twice in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if anchor != now:
                    if size >= BUCKET_BYTES:
                        yield bucket(len(names))
                        names, texts, many, size = [], [], [], 0
                    now = anchor
                names.append(name)
                texts.append(text)
                many.append(twice)
                size += len(text)
        if names:
            yield bucket(len(names))

    return run


def _exploded(hot: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments: equal strings meet by their bytes in Spark."""
    rows = hot.select("name", "many", "segment", F.explode(F.sequence(F.lit(0), F.octet_length("segment") - length)).alias("place"))
    rows = rows.select("name", "many", "place", F.substring("segment", F.col("place") + 1, F.lit(length)).alias("string"))
    twice = rows.groupBy("string").agg((F.count("*") > 1).alias("more"), F.max("many").alias("any")).where("more or any").select("string")
    return rows.join(twice, "string", "left_semi").groupBy("name").agg(F.collect_list("place").alias("places"))


def _covered(starts: np.ndarray, total: int, length: int) -> np.ndarray:
    near = np.zeros(total + length + 1, np.int32)
    near[starts] += 1
    near[starts + length] -= 1
    return np.cumsum(near)[:total] > 0


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ends, data, found = _row(batch, i, "ends", "data", "found")
                places = {bytes(x["name"]): x["places"] for x in found or []}
                starts = np.zeros(len(data) + 1, bool)
                if places:
                    first, count, _ = _runs(data, _mask(batch, i, len(data)), length)
                    for name, a, n in zip(_named(data, first, count, length), first.tolist(), count.tolist()):
                        if name in places:
                            own = places[name]
                            starts[a : a + n] = True if own is None else np.isin(np.arange(n), own)
                gone = _covered(np.flatnonzero(starts), len(data), length)
                kept, removed, spans = [], [], []
                for b, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                    own = gone[b:e]
                    kept.append(data[b:e][~own].tobytes())
                    removed.append(int(own.sum()))
                    spans.append(int((own & ~np.r_[False, own[:-1]]).sum()))
                yield _texts(batch.column("rest")[i].values, kept, removed, spans)

    return run


def _texts(rest: pa.Array, kept: list[bytes], removed: list[int], spans: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rest, pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["rest", "kept", "n_removed", "n_spans"])


def _uncut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw, ends = _unzipped(batch, i), batch.column("ends")[i].as_py()
            own = [raw[b:e] for b, e in zip([0, *ends[:-1]], ends)]
            yield _texts(batch.column("rest")[i].values, own, [0] * len(own), [0] * len(own))


def _collected(flags: DataFrame) -> DataFrame:
    return flags.groupBy("block").agg(F.collect_list("packed").alias("packed"))


def _sorted(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(min(n, max(width(rows.sparkSession), 1)), "bucket").sortWithinPartitions("bucket")


def cut(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """For every row of docs: the carried columns as `rest`, kept (bytes), n_removed and n_spans."""
    spark = docs.sparkSession
    texts = blocks(docs, carry, text_col)
    kind = texts.schema["rest"].dataType.simpleString()
    dealt, back = "bucket int, block long, packed binary", "block long, packed binary"
    total = texts.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    n = max(width(spark), math.ceil(total / NAME_BYTES))
    names = stored(_sorted(texts.select("block", "ends", "data").mapInArrow(_samples(length, n), dealt), n).mapInArrow(_repeated_samples, back), "sample-names")
    schema = f"block long, ends array<bigint>, data binary, rest {kind}, mask binary, n long, o_ends array<bigint>, o_data binary, o_rest {kind}"
    split = stored(texts.join(_collected(names), "block", "left").mapInArrow(_candidates(length), schema), "candidates", drop=(*texts.inputFiles()[:1], *names.inputFiles()[:1]))
    segments = stored(split.where("n > 0").select("block", "data", "mask").mapInArrow(_segments(length), "block long, anchor long, name binary, segment binary, many boolean"), "segments")
    once = stored(segments.groupBy("name").agg(F.first("anchor").alias("anchor"), F.first("segment").alias("segment"), (F.max("many") | (F.count("*") > 1)).alias("many")), "different-segments")
    groups = once.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.octet_length("segment")).alias("bytes"))
    dealt_ = stored(once.join(groups, "anchor"), "dealt-segments", drop=once.inputFiles()[:1])
    whole = dealt_.where("many").select("name", F.lit(None).cast("array<int>").alias("places"))
    # A segment alone with its anchor has no equal; one that is repeated itself needs no answer.
    wanted = dealt_.where("k > 1")
    small_ = wanted.where(F.col("bytes") <= HOT_BYTES).select("anchor", "name", "segment", "many")
    size = wanted.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    tasks = max(width(spark), math.ceil(size / TASK_BYTES))
    found = small_.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_buckets(length), "name binary, places array<int>")
    hot = wanted.where(F.col("bytes") > HOT_BYTES)
    if not hot.isEmpty():
        found = found.union(_exploded(hot, length))
    flags = stored(whole.union(found.join(whole, "name", "left_anti")), "repeated-suffixes")
    told = segments.select("block", "name").join(flags, "name").groupBy("block").agg(F.collect_list(F.struct("name", "places")).alias("found"))
    out = f"rest {kind[6:-1]}, kept binary, n_removed long, n_spans long"
    touched = split.select("block", "ends", "data", "rest", "mask").join(told, "block", "left").mapInArrow(_cut(length), out)
    others = split.select(F.col("o_ends").alias("ends"), F.col("o_data").alias("data"), F.col("o_rest").alias("rest")).mapInArrow(_uncut, out)
    return touched.union(others)


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs."""
    return cut(docs, ("doc_id",), length).select("rest.doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def keep(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated passages cut out of text, and n_chars, if there is one, counted anew.
    Where a cut has split a character, its remains become U+FFFD."""
    others = tuple(c for c in docs.columns if c != "text")
    text = F.make_valid_utf8(F.col("kept").cast("string")) if hasattr(F, "make_valid_utf8") else F.col("kept").cast("string")
    flat = cut(docs, others, length).select("rest.*", text.alias("text"), F.col("n_removed").alias("__cut"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        flat = flat.withColumn("n_chars", F.when(F.col("__cut") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return flat.select(docs.columns)


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT rid, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400),
k AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS key FROM w),
s AS (SELECT rid, i FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)),
r AS (SELECT rid, min(i) AS b, max(i) + 400 AS e FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run
      FROM (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM s)) GROUP BY rid, run),
p AS (SELECT rid, b, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY b), 0) AS a FROM r UNION ALL SELECT rid, n, coalesce(e, 0) FROM d LEFT JOIN (SELECT rid, max(e) AS e FROM r GROUP BY rid) USING (rid)),
t AS (SELECT rid, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS kept FROM p JOIN d USING (rid) GROUP BY rid),
c AS (SELECT rid, count(*) AS n_spans, sum(e - b) AS n_removed FROM r GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (rid) LEFT JOIN c USING (rid)
"""
