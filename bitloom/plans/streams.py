"""Registered queries that run as Structured Streaming over chunks in files, to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import binary
from ..operators import codec
from ..streaming import framing
from . import scratch
from .catalog import field, query, schema, seq, table, text

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LANES = 16  # connections that orders are spread over
NOTE = schema({"Note": seq(field("key", "int64"), text("priority"))})
BODY = schema({"Body": seq(field("size", "uint16", computed={"type": "sum_of_sizes", "targets": ["key", "priority"]}), field("key", "int64"), text("priority"))})


def _chunks(spark, sf_dir, s, root: str) -> str:
    """Orders of each lane as one byte stream, cut into chunks of 1,000 bytes, as files."""
    o = table(spark, sf_dir, "orders")
    w = codec.encode(o, F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority")), s, root, "wire")
    rows = F.sort_array(F.collect_list(F.struct("o_orderkey", F.hex("wire").alias("h"))))
    lanes = w.groupBy((F.col("o_orderkey") % LANES).alias("lane"), (F.floor(F.col("o_orderkey") / 4096)).alias("part")).agg(F.array_join(F.transform(rows, lambda x: x["h"]), "").alias("h"))
    whole = lanes.select("lane", "part", F.unhex("h").alias("bytes"))
    pieces = whole.select("lane", "part", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("bytes") - 1) / 1000).cast("int"))).alias("piece"))
    out = scratch.path(spark, "chunks")
    data = binary.window(F.col("bytes"), F.col("piece") * 1000, 1000)
    pieces.select("lane", (F.col("part") * 1_000_000 + F.col("piece")).alias("order"), data.alias("data")).coalesce(1).write.parquet(out)
    return out


def _drained(spark, result: DataFrame, name: str) -> DataFrame:
    """The stream's rows once all files are read."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = scratch.path(spark, name)
    q = result.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/rows")


def _source(spark, path: str) -> DataFrame:
    return spark.readStream.schema("lane long, order long, data binary").option("maxFilesPerTrigger", 1).parquet(path)


_SQL = f"""SELECT o_orderkey % {LANES} AS lane, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(strlen(o_orderpriority)) AS BIGINT) AS bytes FROM orders GROUP BY 1"""


@query(_SQL)
def stream_greedy(spark, sf_dir):
    """Messages without lengths: each is what a decode consumes, and what is incomplete waits."""
    src = _source(spark, _chunks(spark, sf_dir, NOTE, "Note"))
    m = _drained(spark, framing.decode_stream(src, "lane", "order", "data", NOTE, "Note"), "greedy")
    return m.groupBy(F.col("key").alias("lane")).agg(F.count("*").alias("n"), F.sum("decoded.key").alias("keys"), F.sum(F.octet_length("decoded.priority")).alias("bytes"))


@query(_SQL)
def stream_prefixed(spark, sf_dir):
    """Messages with a length in front; the state holds the tail of each connection."""
    src = _source(spark, _chunks(spark, sf_dir, BODY, "Body"))
    found = framing.decode_stream(src, "lane", "order", "data", BODY, "Body", framing.Framing("uint16"))
    m = _drained(spark, found, "prefixed")
    return m.groupBy(F.col("key").alias("lane")).agg(F.count("*").alias("n"), F.sum("decoded.key").alias("keys"), F.sum(F.octet_length("decoded.priority")).alias("bytes"))


@query("""SELECT event_type AS kind, CAST(date_diff('hour', TIMESTAMP '1970-01-01', ts) // 6 AS BIGINT) AS quarter_day, count(*) AS n FROM events
          WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    """Windows of six hours on decoded time, with a watermark of one day; those that the watermark
    has passed are emitted, here all of the days before the last."""
    s = schema({"E": seq(field("seconds", "uint32"), text("kind"))})
    e = table(spark, sf_dir, "events")
    out = scratch.path(spark, "events")
    w = codec.encode(e, F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"), F.col("event_type").alias("kind")), s, "E", "wire")
    w.select("wire").write.parquet(out)
    src = spark.readStream.schema("wire binary").parquet(out)
    d = codec.decode(src, "wire", s, "E", "m").select(F.timestamp_seconds("m.seconds").alias("at"), F.col("m.kind").alias("kind"))
    counts = d.withWatermark("at", "6 hours").groupBy(F.window("at", "6 hours"), "kind").agg(F.count("*").alias("n"))
    got = _drained(spark, counts, "windows")
    day = got.select(F.max("window.end").alias("last")).first()["last"]
    kept = got.where(F.date_trunc("day", "window.start") < F.date_trunc("day", F.lit(day))) if day is not None else got
    return kept.select("kind", F.floor(F.unix_timestamp("window.start") / 21600).alias("quarter_day"), "n")
