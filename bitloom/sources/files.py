"""Files of binary data as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.binary import window
from ..operators import codec
from ..schema.model import Schema, load, loads


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of whole files; unused contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_schema(spark: SparkSession, path: str) -> Schema:
    """A schema file, JSON5 or JSON, from any store that Spark reads."""
    return load(loads(spark.read.text(path, wholetext=True).first()[0]))


def records(files: DataFrame, length: int, header: int = 0) -> DataFrame:
    """A row per fixed-size record: path, record number and its bytes; a partial one is left out."""
    n = F.floor((F.octet_length("content") - header) / length).cast("int")
    at = files.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("record"))
    return at.select("path", "record", window(F.col("content"), F.col("record") * length + header, length).alias("data"))


def slice_at(df: DataFrame, data: str, at, size, out: str = "part") -> DataFrame:
    """Random access: `size` bytes at `at`, from the end where it is negative."""
    d, at = F.col(data), F.lit(at) if isinstance(at, int) else at
    place = F.when(at < 0, F.octet_length(d) + at).otherwise(at)
    bad = (place < 0) | (place > F.octet_length(d))
    return df.withColumn(out, F.when(bad, F.raise_error(F.lit("OUT_OF_BOUNDS"))).otherwise(window(d, place, size)))


def write_messages(df: DataFrame, value: str, schema: Schema, root: str, path: str) -> None:
    """Encoded messages as a Parquet table with one binary column more."""
    codec.encode(df, value, schema, root).drop(value).write.parquet(path)


class _Split(InputPartition):
    def __init__(self, path: str, start: int, count: int):
        self.path, self.start, self.count = path, start, count


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.length = options["path"], int(options["recordLength"])
        self.header, self.per = int(options.get("header", 0)), int(options.get("recordsPerPartition", 1 << 20))

    def _open(self, path: str):
        from pyarrow import fs

        local = not ("://" in path and not path.startswith("file:"))
        system, name = (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if local else fs.FileSystem.from_uri(path)
        return system, name

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, name = self._open(self.path)
        info = system.get_file_info(name)
        files = [info]
        if info.type != fs.FileType.File:  # as Spark's own readers, without hidden files and marks
            files = [f for f in system.get_file_info(fs.FileSelector(name)) if f.type == fs.FileType.File and f.base_name[:1] not in "._"]
        return [_Split(f.path, at, min(self.per, n - at)) for f in files for n in [max(0, (f.size - self.header) // self.length)] for at in range(0, n, self.per)] or [_Split(self.path, 0, 0)]

    def read(self, split: _Split) -> Iterator[tuple]:
        if not split.count:
            return
        system, _ = self._open(self.path)
        with system.open_input_file(split.path) as f:
            step = max(1, (4 << 20) // self.length)
            for at in range(split.start, split.start + split.count, step):
                n = min(step, split.start + split.count - at)
                raw = f.read_at(n * self.length, self.header + at * self.length)
                for i in range(n):
                    yield split.path, at + i, raw[i * self.length : (i + 1) * self.length]


class RecordSource(DataSource):
    """spark.read.format("bitloom.records").option("recordLength", n).load(path): files of fixed-size
    records, read by ranges, so that one large file makes many partitions."""

    @classmethod
    def name(cls) -> str:
        return "bitloom.records"

    def schema(self) -> str:
        return "path string, record long, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
