"""Token counts as a delta-maintained rollup.

A change is an insert, a delete or a revised count of one document under one tokenizer version, with
the images before and after it. It becomes signed rows, minus the one and plus the other, which are
summed by source, language and tokenizer version before they are written. Totals are additive, so
they are the sum of all deltas. A batch is a folder of its own in the rollup, written to the side
and renamed when it is complete: a lost executor or driver leaves no half of a batch behind. (The
store must rename a folder at once, as HDFS and local file systems do.) Committing a batch again
changes nothing; a batch of the same name whose delta differs is refused. compact() sums up all
deltas in one folder, with the names and digests of the batches that it holds, so that these still
commit once.

Counts come from tokenizers of byte-pair vocabularies, whose file is the tokenizer version; whole
texts are counted, in Arrow batches.

Defined results: null source or language is a key of its own; a null or empty text has no tokens
but counts as a document; an insert has no image before, a delete none after; a change with neither
adds nothing; repeated changes each count; an empty batch commits and adds nothing; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete, scratch_path, stored

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
IMAGE = "struct<source:string,lang:string,tokenizer:string,tokens:bigint>"
SHORT_WORDS = 10
BLANK = r"[\x20\x09-\x0D]+"


@functools.cache
def _vocabulary(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, counts: dict[str, tuple[str, str]], pattern: str) -> DataFrame:
    """docs without the texts, and a count of tokens for each of `counts`: name -> (column with a
    text, path of the vocabulary). A null text has no tokens."""
    texts = sorted({c for c, _ in counts.values()})
    rest = [c for c in docs.columns if c not in texts and c not in counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0)]
            for text, path in counts.values():
                encode = _vocabulary(path, pattern).encode_ordinary
                columns.append(pa.array([None if x is None else len(encode(x)) for x in batch.column(1 + texts.index(text)).to_pylist()], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["rest", *counts])

    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), *texts)
    kind = src.schema["rest"].dataType.simpleString()
    return src.mapInArrow(run, f"rest {kind}, " + ", ".join(f"{n} long" for n in counts)).select("rest.*", *counts)


class Rollup:
    """Totals kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _folders(self, kind: str) -> list[str]:
        if not self._there(""):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if s.getPath().getName().startswith(kind))

    def _base(self) -> tuple[str | None, dict[str, str]]:
        """The folder of the last compaction, and the batches that it holds with their digests."""
        found: tuple[str | None, dict[str, str]] = None, {}
        for name in self._folders("base="):
            held = {r["batch"]: r["digest"] for r in self.spark.read.parquet(f"{self.path}/{name}/names").collect()}
            if found[0] is None or len(held) > len(found[1]):
                found = name, held
        return found

    def batches(self) -> list[str]:
        """The committed batches, compacted ones included."""
        return sorted({*self._folders("batch="), *self._base()[1]})

    def _digest(self, path: str) -> str:
        row = self.spark.read.schema(DELTA).parquet(path).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (*KEYS, "docs", "tokens")])).alias("x")).first()
        return f"{row['n']}:{row['x']}"

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes: columns before and after, structs of KEYS and tokens. False
        if the batch is committed already; ValueError if that was another delta."""
        name = f"batch={batch}"
        signed = F.array(*[F.struct(F.lit(sign).cast("long").alias("sign"), F.col(image).alias("image")) for sign, image in ((-1, "before"), (1, "after"))])
        rows = changes.select(F.explode(signed).alias("x")).where("x.image is not null")
        sums = rows.groupBy(*[F.col(f"x.image.{k}").alias(k) for k in KEYS]).agg(F.sum("x.sign").alias("docs"), F.sum(F.col("x.sign") * F.col("x.image.tokens")).alias("tokens"))
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        sums.where("docs <> 0 or tokens <> 0").write.parquet(aside)
        held = self._base()[1]
        if not self._there(name) and name not in held:
            nested = f"{name}/{aside.rpartition('/')[2]}"
            if self._fs.rename(self._path(aside), self._path(f"{self.path}/{name}")) and not self._there(nested):
                return True
            _delete(self.spark, f"{self.path}/{nested}")  # another writer was first
            if not self._fs.exists(self._path(aside)):
                sums.where("docs <> 0 or tokens <> 0").write.parquet(aside)
        before = held[name] if name in held else self._digest(f"{self.path}/{name}")
        same = before == self._digest(aside)
        _delete(self.spark, aside)
        if not same:
            raise ValueError(f"batch {batch!r} is committed already, with another delta")
        return False

    def _deltas(self) -> DataFrame:
        base, held = self._base()
        paths = [f"{self.path}/{b}" for b in self._folders("batch=") if b not in held]
        if base is not None:
            paths.append(f"{self.path}/{base}/delta")
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*paths)

    def totals(self) -> DataFrame:
        """Live documents and tokens by source, language and tokenizer version."""
        return self._deltas().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """All deltas summed up in one folder; those that it holds are deleted once it is there."""
        base, held = self._base()
        own = [b for b in self._folders("batch=") if b not in held]
        names = [*held.items(), *((b, self._digest(f"{self.path}/{b}")) for b in own)]
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{aside}/delta")
        self.spark.createDataFrame(names, "batch string, digest string").coalesce(1).write.parquet(f"{aside}/names")
        self._fs.rename(self._path(aside), self._path(f"{self.path}/base={uuid.uuid4().hex}"))
        for old in [*([base] if base else []), *self._folders("batch=")]:
            if old == base or old in dict(names):
                _delete(self.spark, f"{self.path}/{old}")


def _image(tokenizer: str, tokens: str) -> Column:
    return F.struct(F.col("source"), F.col("lang"), F.lit(tokenizer).alias("tokenizer"), F.coalesce(F.col(tokens), F.lit(0)).alias("tokens"))


def maintained(docs: DataFrame, first: str, second: str, pattern: str) -> DataFrame:
    """The life of a corpus, and its totals after each batch: all documents come in under the first
    tokenizer version, are counted by the second, lose their repeated lines (revised counts of the
    first), and those of fewer than ten words are deleted. The second batch comes twice, and the
    deltas are compacted before the last."""
    spark = docs.sparkSession
    once = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    words = F.size(F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), BLANK, -1), ""))
    flat = docs.select("source", "lang", "text", (words < SHORT_WORDS).alias("short"), F.when(once != F.col("text"), once).alias("once"))
    counted_ = stored(counted(flat, {"v1": ("text", first), "v2": ("text", second), "r1": ("once", first)}, pattern), "counts")
    rollup, none = Rollup(spark, scratch_path(spark, "rollup")), F.lit(None).cast(IMAGE)
    one, two = (path.rpartition("/")[2] for path in (first, second))
    counted_ = counted_.withColumn("left", F.coalesce("r1", "v1"))
    insert = lambda name, count: counted_.select(none.alias("before"), _image(name, count).alias("after"))
    states = []

    def state(batch: str) -> None:
        states.append(stored(rollup.totals().select(F.lit(batch).alias("batch"), *KEYS, "docs", "tokens"), "totals"))

    rollup.commit("1-load", insert(one, "v1"))
    state("1-load")
    rollup.commit("2-second-version", insert(two, "v2"))
    rollup.commit("2-second-version", insert(two, "v2"))
    state("2-second-version")
    rollup.commit("3-revised", counted_.where("r1 is not null").select(_image(one, "v1").alias("before"), _image(one, "r1").alias("after")))
    state("3-revised")
    rollup.compact()
    gone = counted_.where("short")
    rollup.commit("4-deleted", gone.select(_image(one, "left").alias("before"), none.alias("after")).union(gone.select(_image(two, "v2").alias("before"), none.alias("after"))))
    state("4-deleted")
    return functools.reduce(DataFrame.union, states)
