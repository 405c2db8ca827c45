"""Near-duplicate detection by SimHash with deletion-variant signatures.

A document's fingerprint has 64 bits: bit i is set if it is set in over half of the hashes of the
document's word shingles. Two fingerprints link at `radius` (3) or fewer differing bits. Cut into
two segments, one of the two then differs by one bit at most, so both fingerprints have the same
value in one segment once one well-chosen bit of it is deleted. The index holds, per distinct
fingerprint and segment, one variant for each deleted bit; equal variants meet by a shuffle on the
variant, and the full distance is verified there. Fingerprints that many documents share enter
the index once. A variant that more than `BLOCK` fingerprints share is cut into blocks, and each
pair of blocks is verified in a group of its own, so no group is unbounded and no link is lost;
within a group only a spanning forest of its links is emitted, never all pairs.

Defined results: a null or empty text, and one of white space only, has fingerprint zero and links
like any other; a text of fewer words than a shingle is one shingle; repeated rows get the same
component; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored, width
from .components import components

SEED, BITS, SEGMENT, RADIUS = 42, 64, 32, 3
BLOCK = 4096  # fingerprints of a variant that are verified together
RUN = 16  # up to so many, a variant's fingerprints are compared by shifting columns
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(t), SEED) for t in zip(*(words[k:] for k in range(shingle)))]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """key, fp: one row per fingerprint, segment and deleted bit."""
    keys = []
    for segment in range(BITS // SEGMENT):
        part = F.shiftrightunsigned("fp", segment * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1))
        keys += [part.bitwiseAND(F.lit((1 << SEGMENT) - 1 & ~(1 << bit))).bitwiseOR(F.lit((segment * SEGMENT + bit) << SEGMENT)) for bit in range(SEGMENT)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between these distinct fingerprints."""
    todo, out = fps.copy(), []
    while len(todo):
        stack, todo = [todo[0]], todo[1:]
        while stack and len(todo):
            at = stack.pop()
            near = np.bitwise_count(todo ^ at) <= RADIUS
            if near.any():
                found = todo[near]
                todo = todo[~near]
                stack += list(found)
                out += [(int(at), int(x)) for x in found]
    return out


def _pairs_of_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    a, b = [], []
    for shift in range(1, min(RUN, int(sizes.max(initial=1)))):
        i = np.flatnonzero((keys[shift:] == keys[:-shift]))
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= RADIUS]
        a.append(fps[i])
        b.append(fps[i + shift])
    for s, n in zip(starts[sizes > RUN].tolist(), sizes[sizes > RUN].tolist()):
        if edges := _forest(np.unique(fps[s : s + n])):
            x = np.array(edges, dtype=np.uint64)
            a.append(x[:, 0])
            b.append(x[:, 1])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _verify(block: int | None):
    """Over (key, fp) rows sorted by key: links as (null, a, b). Of a key with over `block` rows,
    the rows themselves as (key, fp, null). No more than a batch and a block stay in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        keys, fps, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            x, y = _pairs_of_runs(k, f)
            return pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], schema=schema)

        def passed(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(f.view(np.int64)), pa.nulls(len(k), pa.int64())], schema=schema)

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            before = hot  # its last rows may lie in front of the next hot key's
            if block and len(keys) - last > block:
                hot, last = keys[-1], len(keys)
            if last:
                k, f = keys[:last], fps[:last]
                keys, fps = keys[last:], fps[last:]
                names, sizes = np.unique(k, return_counts=True)
                big = np.isin(k, names[sizes > block]) | (k == hot) | (k == before) if block else np.zeros(len(k), bool)
                if big.any():
                    yield passed(k[big], f[big])
                yield links(k[~big], f[~big])
        if len(keys):
            yield passed(keys, fps) if hot is not None and keys[0] == hot else links(keys, fps)

    return run


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: enough links between distinct fingerprints to connect whatever is within reach."""
    n = width(fps.sparkSession)
    rows = _variants(fps).repartition(n, "key").sortWithinPartitions("key")
    found = stored(rows.mapInArrow(_verify(block), "key long, a long, b long"), "simhash-links")
    out = found.where("key is null").select("a", "b")
    hot = found.where("key is not null")
    if hot.isEmpty():
        return out
    # Blocks of a hot variant, each pair of them a group of its own.
    blocks = hot.join(hot.groupBy("key").agg(F.ceil(F.count("*") / block).alias("n")), "key").withColumn("at", F.pmod(F.xxhash64("a"), "n"))
    cut = blocks.select("key", F.col("a").alias("fp"), "at", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(F.xxhash64("key", F.least("at", "other"), F.greatest("at", "other")).alias("key"), "fp")
    return out.union(cut.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_verify(None), "key long, a long, b long").select("a", "b"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that is reachable) for every row of docs."""
    prints = stored(fingerprints(docs), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes.select("fp"), block)).select(F.col("node").alias("fp"), "root")
    linked = classes.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(least, "root").select("fp", "least")
    names = stored(classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-names")
    return prints.join(names, "fp", "left").select("doc_id", "fp", "component_id")


def keep(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One document of each component, that with the least doc_id, as it is; of rows that repeat
    its doc_id one stays. A document without a doc_id represents nothing and stays."""
    gone = near_duplicates(docs, block).where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.join(small(stored(gone, "simhash-gone")), "doc_id", "left_anti")
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-again")
    if again.isEmpty():
        return left.select(docs.columns)
    return left.join(small(again), "doc_id", "left_anti").select(docs.columns).union(left.join(small(again), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns))


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
