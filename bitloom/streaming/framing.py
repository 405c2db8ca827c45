"""Messages out of chunked streams.

`Framer` is the state of one connection: what has come in and not yet made a message. Two ways to
find messages: each has a length prefix, or each is decoded greedily, and what is incomplete waits
for more. `frames` runs a Framer per key over a streaming or static DataFrame of chunks; on a stream
the undecoded tail is Spark state, on a static one the chunks of a key are folded in order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..errors import CodecError
from ..operators.bits import Reader
from ..operators.codec import _decoder, _key, decode
from ..operators.decode_local import UINT
from ..schema.model import Schema

OUT = "index long, message binary, error string"


@dataclass
class Framing:
    """length_type: a uint or varint prefix ("uint16", "leb128", ...); greedy: decode `root`, and a
    message is what it consumed. length counts the bytes behind the prefix, plus `extra`. count, or a
    number of count_type at the stream's start, ends the stream after so many messages; what follows
    them is dropped."""

    length_type: str | None = None
    big_endian: bool = True
    extra: int = 0
    schema_key: str | None = None
    root: str | None = None
    count: int | None = None
    count_type: str | None = None

    def __post_init__(self) -> None:
        if self.count is not None and self.count_type is not None:
            raise ValueError("a stream has a given count or a count prefix, not both")
        if (self.length_type is None) == (self.root is None):
            raise ValueError("a framing has a length prefix or a type to decode, not both")

    @classmethod
    def greedy(cls, schema: Schema, root: str, **more) -> Framing:
        return cls(schema_key=_key(schema), root=root, **more)


class Framer:
    """total: how many messages there are, -1 if that isn't known."""

    def __init__(self, framing: Framing, tail: bytes = b"", index: int = 0, total: int = -1):
        self.framing, self.tail, self.index = framing, tail, index
        self.total = framing.count if framing.count is not None else total

    def feed(self, chunk: bytes) -> Iterator[tuple[int, bytes]]:
        data, at = self.tail + chunk, 0
        if self.framing.count_type is not None and self.total < 0:
            at = self._count(data)
        while at < len(data) and (self.total < 0 and self.framing.count_type is None or self.index < self.total):
            end = self._end(data, at)
            if end is None or end > len(data):
                break
            yield self.index, data[at:end]
            self.index, at = self.index + 1, end
        self.tail = b"" if 0 <= self.total <= self.index else data[at:]

    def _count(self, data: bytes) -> int:
        r, kind = Reader(data), self.framing.count_type
        try:
            self.total = r.integer(UINT[kind], self.framing.big_endian) if kind in UINT else r.varint(kind)
        except CodecError as e:
            if e.code != "INCOMPLETE_DATA":
                raise
            return 0
        return r.at

    def _end(self, data: bytes, at: int) -> int | None:
        f, r = self.framing, Reader(data, at)
        try:
            if f.length_type is None:
                r = Reader(data[at:])  # positions of a message count from its start
                decoder = _decoder(f.schema_key, f.root, False, False)[0]
                r.msb = decoder.msb
                decoder.decode_at(r)
                return at + r.at + (r.bit > 0)
            n = r.integer(UINT[f.length_type], f.big_endian) if f.length_type in UINT else r.varint(f.length_type)
            return r.at + n + f.extra
        except CodecError as e:
            if e.code != "INCOMPLETE_DATA":
                raise
            return None

    def finish(self) -> tuple[int, bytes, str] | None:
        """The end of the stream: what is left is an incomplete message."""
        short = bool(self.tail) or self.index < self.total
        return (self.index, self.tail, "INCOMPLETE_DATA") if short else None


def frames(chunks: DataFrame, key: str, order: str, data: str, framing: Framing, finish: bool = True) -> DataFrame:
    """key, index, message, error of a static DataFrame of chunks: each key's chunks in order. A
    key is one connection and is folded by one task, a batch of chunks at a time."""
    kind = chunks.schema[key].dataType.simpleString()
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = chunks.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(data).alias("data")).repartition(n, "key").sortWithinPartitions("key", "order").select("key", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, framer, first = None, Framer(framing), True

        def close(out: list) -> None:
            if not first and finish and (last := framer.finish()):
                out.append((now, *last))

        out: list = []
        for pdf in batches:
            for k, chunk in zip(pdf["key"], pdf["data"]):
                if first or k != now:
                    close(out)
                    now, framer, first = k, Framer(framing), False
                out += [(k, i, m, None) for i, m in framer.feed(bytes(chunk) if chunk is not None else b"")]
            yield pd.DataFrame(out, columns=["key", "index", "message", "error"])
            out = []
        close(out)
        yield pd.DataFrame(out, columns=["key", "index", "message", "error"])

    return rows.mapInPandas(run, f"key {kind}, {OUT}")


class _Processor(StatefulProcessor):
    def __init__(self, framing: Framing, idle_ms: int):
        self.framing, self.idle_ms = framing, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tail", StructType([StructField("tail", BinaryType()), StructField("index", LongType()), StructField("total", LongType())]))

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        tail, index, total = self.state.get() if self.state.exists() else (b"", 0, -1)
        framer, out = Framer(self.framing, bytes(tail), index, total), []
        pdf = pd.concat(list(rows)).sort_values("order", kind="stable")
        for chunk in pdf["data"]:
            out += [(key[0], i, m, None) for i, m in framer.feed(bytes(chunk))]
        self.state.update((framer.tail, framer.index, framer.total))
        if self.idle_ms:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", "index", "message", "error"])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        tail, index, total = self.state.get() if self.state.exists() else (b"", 0, -1)
        last = Framer(self.framing, bytes(tail), index, total).finish()
        self.state.clear()
        yield pd.DataFrame([(key[0], *last)] if last else [], columns=["key", "index", "message", "error"])

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame, key: str, order: str, data: str, framing: Framing, idle_ms: int = 0) -> DataFrame:
    """As frames, for a streaming DataFrame: tails are kept in the state store. A connection idle
    for idle_ms ends, and its tail comes out with an error."""
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(data).alias("data"))
    return rows.groupBy("key").transformWithStateInPandas(_Processor(framing, idle_ms), f"key {kind}, {OUT}", "Append", "ProcessingTime" if idle_ms else "None")


def decode_stream(chunks: DataFrame, key: str, order: str, data: str, schema: Schema, root: str, framing: Framing | None = None) -> DataFrame:
    """key, index, decoded, error: the messages of chunked connections, decoded. Without a framing
    they are found greedily. With a length prefix, root is the type of prefix and body together."""
    run = frame_stream if chunks.isStreaming else frames
    found = run(chunks, key, order, data, framing or Framing.greedy(schema, root))
    whole = found.withColumn("message", F.when(F.col("error").isNull(), F.col("message")))
    return decode(whole, "message", schema, root).select("key", "index", "decoded", "error")
