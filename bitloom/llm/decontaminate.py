"""Benchmark decontamination over a distributed positional inverted index.

`build_index` cuts the documents into segments and stores, per segment, the postings of every
token: for each term its positions in the segment, sorted. A segment's positions run over all its
documents with a gap between two documents, so no phrase crosses from one to the next. `search`
takes the corpus-wide count of each query term from the index, orders each phrase's terms from the
rarest on, and intersects, segment by segment, the offset-adjusted position lists in that order: a
list of candidate starts only gets shorter, and most phrases end at their rarest term. Phrases that
share a run of terms meet the same lists; nothing is shuffled but term counts. Queries are a stated
set: they are broadcast in blocks of a fixed number of phrases, whatever their total.

The contamination rule: texts are lower-cased in A-Z and cut into words; a window is `WINDOW`
consecutive words of an item, or the whole item if it has fewer; a document word inside any
occurrence of a window is hit; a document is contaminated if it has hits in at least one word of 20.

Defined results: a null or empty text has no words and no hits; an item without words has no
window; items of equal text each count, and so do repeated rows; items with a null id are left out;
an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored

WINDOW = 13
SEGMENT_BYTES = 8 << 20  # of text in a segment; a longer text is a segment of its own
PHRASES = 200_000  # sent to the executors at once
#: Lower-cases A-Z and blanks 00-2F, 3A-60 and 7B-7F; bytes of other code points are word bytes.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "ids array<bigint>, starts array<int>, n_words array<int>, terms array<string>, ends array<int>, positions binary"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def _segment(ids: list[int | None], texts: list[list[bytes]], gap: int) -> dict:
    """One index row. starts: position of each document's first word."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes + gap)][:-1]
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    flat = np.fromiter((numbers[w] for w in chain.from_iterable(texts)), dtype=np.int32, count=int(sizes.sum()))
    place = np.arange(len(flat), dtype=np.int32) + np.repeat((np.arange(len(texts)) * gap).astype(np.int32), sizes)
    order = np.argsort(flat, kind="stable")
    ends = np.cumsum(np.bincount(flat, minlength=len(numbers))) if len(flat) else np.zeros(0, np.int64)
    return {"ids": ids, "starts": starts.tolist(), "n_words": sizes.tolist(), "terms": [w.decode() for w in numbers], "ends": ends.tolist(), "positions": place[order].astype("<i4").tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 64) -> DataFrame:
    """The stored index: a row per segment. `gap`: positions left free between documents; phrases
    of up to gap + 1 words can be searched."""
    names = [c.split()[0] for c in INDEX.split(", ")]
    schema = pa.schema(list(zip(names, (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py()
                ids.append(i.as_py())
                texts.append(words(t))
                size += len(t or "")
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_pylist([_segment(ids, texts, gap)], schema)
                    ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(ids, texts, gap)], schema)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(src.mapInArrow(run, INDEX), "postings")


def windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """phrase (array of words) and the sorted ids of the items that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = [x.decode() for x in words(t)]
                for k in range(max(1, len(w) - size + 1) if w else 0):
                    out[i, tuple(w[k : k + size])] = None
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.string()), pa.array([list(p) for _, p in out], pa.list_(pa.string()))], ["item", "phrase"])

    src = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    return src.mapInArrow(run, "item string, phrase array<string>").groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n over the whole index, for the given terms; counts are summed before the shuffle."""
    own = index.select(F.explode(F.arrays_zip("terms", "ends", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("begins"))).alias("t"))
    return own.select(F.col("t.terms").alias("term"), (F.col("t.ends") - F.col("t.begins")).cast("long").alias("n")).join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def occurrences(positions: dict[str, np.ndarray], phrase: list[str], order: list[int]) -> np.ndarray:
    """Starts of the phrase: offset-adjusted lists, intersected in the given order."""
    starts = None
    for k in order:
        own = positions.get(phrase[k])
        if own is None:
            return np.zeros(0, np.int64)
        if starts is None:
            starts = own - k
            continue
        at = np.searchsorted(own, starts + k)
        starts = starts[own[np.minimum(at, len(own) - 1)] == starts + k]
        if not len(starts):
            break
    return starts


def near(positions: dict[str, np.ndarray], phrase: list[str], order: list[int], span: int) -> np.ndarray:
    """Positions of the rarest term whose `span` words to either side hold all other terms."""
    at = positions.get(phrase[order[0]], np.zeros(0, np.int64))
    for k in order[1:]:
        own = positions.get(phrase[k], np.zeros(0, np.int64))
        at = at[np.searchsorted(own, at + span, "right") > np.searchsorted(own, at - span, "left")]
    return at


class _Segment:
    """An index row, opened for reading."""

    def __init__(self, row: dict, wanted: set[str]):
        self.ids, self.starts, self.n_words = row["ids"], np.array(row["starts"], np.int64), np.array(row["n_words"], np.int64)
        flat, ends = np.frombuffer(row["positions"], "<i4"), row["ends"]
        self.positions = {t: flat[ends[i - 1] if i else 0 : ends[i]].astype(np.int64) for i, t in enumerate(row["terms"]) if t in wanted}

    def documents(self, at: np.ndarray) -> np.ndarray:
        """The row of each position; an empty document shares its start with the next gap."""
        return np.searchsorted(self.starts, at, "right") - 1


def _plan(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases with `rank`: the corpus-wide count of each of their terms, missing terms at 0."""
    terms = phrases.select(F.explode("phrase").alias("term")).distinct()
    counts = term_counts(index, terms)
    placed = phrases.select("phrase", "items", F.posexplode("phrase").alias("k", "term")).join(counts, "term", "left")
    ranks = placed.groupBy("phrase").agg(F.first("items").alias("items"), F.sort_array(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n")))).alias("r"))
    return ranks.select("phrase", "items", F.col("r.n").alias("rank"))


def _blocks(plan: DataFrame, block: int) -> list:
    """The planned phrases that can occur, as broadcasts of at most `block` each."""
    send, rows, out = plan.sparkSession.sparkContext.broadcast, [], []
    for r in plan.where(F.array_min("rank") > 0).toLocalIterator():
        order = sorted(range(len(r["phrase"])), key=lambda k: r["rank"][k])
        rows.append((list(r["phrase"]), order, list(r["items"])))
        if len(rows) == block:
            out.append(send(rows))
            rows = []
    return [*out, send(rows)] if rows else out


def _each(blocks: list) -> Iterator[list]:
    """The phrases of each block; of several blocks a worker holds one at a time."""
    for sent in blocks:
        yield sent.value
        if len(blocks) > 1:
            sent._value = None
            del sent._value


def search(index: DataFrame, phrases: DataFrame, span: int | None = None, block: int = PHRASES) -> DataFrame:
    """doc_id, item, start, length: where documents have the phrases, exactly, or with `span` where
    all words of a phrase lie within that many words of its rarest one."""
    spark = index.sparkSession
    schema = "doc_id long, item string, start int, length int"

    blocks = _blocks(_plan(index, phrases), block)
    names, types = ["doc_id", "item", "start", "length"], (pa.int64(), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for rows in _each(blocks):
                    seg, out = _Segment(row, {w for p, _, _ in rows for w in p}), []
                    for phrase, order, items in rows:
                        at = occurrences(seg.positions, phrase, order) if span is None else near(seg.positions, phrase, order, span)
                        for x, d in zip(at.tolist(), seg.documents(at).tolist()):
                            out += [(seg.ids[d], i, int(x - seg.starts[d]), len(phrase)) for i in items]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], names)

    return index.mapInArrow(run, "doc_id long, item string, start int, length int")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, block: int = PHRASES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs."""
    index = build_index(docs, gap=max(64, size))
    blocks = _blocks(_plan(index, stored(windows(items, size), "phrases")), block)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.array(row["starts"], np.int64) + np.array(row["n_words"], np.int64)
                edges, items = np.zeros(int(ends.max(initial=0)) + 2, np.int32), defaultdict(set)
                for rows in _each(blocks):
                    seg = _Segment(row, {w for p, _, _ in rows for w in p})
                    for phrase, order, own in rows:
                        at = occurrences(seg.positions, phrase, order)
                        if len(at):
                            np.add.at(edges, at, 1)
                            np.add.at(edges, at + len(phrase), -1)
                            for d in np.unique(seg.documents(at)).tolist():
                                items[d].update(own)
                hit = np.r_[0, np.cumsum(np.cumsum(edges) > 0)]
                n_hit = (hit[ends] - hit[np.array(row["starts"], np.int64)]).tolist()
                found = [sorted(items.get(d, ())) for d in range(len(row["ids"]))]
                shas = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["n_words"], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array(shas), pa.array([20 * h >= n and h > 0 for h, n in zip(n_hit, row["n_words"])])], names)

    return index.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def keep(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, as they are. A document is named by its doc_id;
    one without stays."""
    gone = contamination(docs, items, size).where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(small(stored(gone, "contaminated")), "doc_id", "left_anti").select(docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark WHERE item_id IS NOT NULL),
     s AS (SELECT item, w, unnest(range(0, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0),
     win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i + 1:i + 13], ' ') AS k FROM s),
     sizes AS (SELECT DISTINCT n FROM win),
     spot AS (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d JOIN sizes ON len(w) >= n),
     hit AS (SELECT rid, i, c.n, item FROM (SELECT rid, i, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM spot) c JOIN win ON c.n = win.n AND c.k = win.k),
     pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
     own AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN own USING (rid)
"""
