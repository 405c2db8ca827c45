"""Relations between the records of messages: what selectors and pointers mean as joins, windows
and aggregates over one row per record (message, index, type, bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(records: DataFrame, message: str, order: str, size: Column | str, out: str = "offset") -> DataFrame:
    """position_of: where each record starts in its message. A message's records are one window
    partition; messages are bounded, the number of messages is not."""
    w = Window.partitionBy(message).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)))


def occurrences(records: DataFrame, message: str, kind: str, order: str, out: str = "occurrence") -> DataFrame:
    """The number of each record among those of its type in its message, from 0."""
    return records.withColumn(out, F.row_number().over(Window.partitionBy(message, kind).orderBy(order)) - 1)


def first_of(records: DataFrame, message: str, order: str, value: str, condition: Column) -> DataFrame:
    """first<T>: per message the value of the first record that meets the condition."""
    return records.where(condition).groupBy(message).agg(F.min_by(value, order).alias(value))


def last_of(records: DataFrame, message: str, order: str, value: str, condition: Column) -> DataFrame:
    return records.where(condition).groupBy(message).agg(F.max_by(value, order).alias(value))


def corresponding(left: DataFrame, right: DataFrame, message: str, kind: str, order: str, left_type: str, right_type: str) -> DataFrame:
    """corresponding<T>: records of one type with the same-numbered ones of another."""
    a = occurrences(left.where(F.col(kind) == left_type), message, kind, order)
    b = occurrences(right.where(F.col(kind) == right_type), message, kind, order)
    return a.alias("a").join(b.alias("b"), (F.col(f"a.{message}") == F.col(f"b.{message}")) & (F.col("a.occurrence") == F.col("b.occurrence")))


def sizes_by_type(records: DataFrame, message: str, kind: str, size: Column | str) -> DataFrame:
    """sum_of_type_sizes."""
    return records.groupBy(message, kind).agg(F.sum(size).alias("size"), F.count("*").alias("records"))


def dereferenced(pointers: DataFrame, targets: DataFrame, message: str, pointer: str, offset: str) -> DataFrame:
    """Back references as an equi-join on (message, offset)."""
    return pointers.join(targets.withColumnRenamed(offset, pointer), [message, pointer], "left")


def containing(points: DataFrame, sections: DataFrame, message: str, at: str, start: str, end: str, block: int = 4096) -> DataFrame:
    """The sections that contain a position: a range join made an equi-join on blocks of positions,
    each section listed in every block it touches."""
    s = sections.withColumn("__block", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col(end) - 1) / block))))
    p = points.withColumn("__block", F.floor(F.col(at) / block))
    return p.join(s, [message, "__block"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__block")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, order: str, values: list[str]) -> DataFrame:
    """left with the values of the last row of right of its key that is not later; of rows of right
    at one time, the last by `order`. Both sides become one, sorted once by key and time, and the
    values are carried on by a window: no row meets more than the row before it. Null times of
    right are no match, and a row of left without one finds none."""
    held = F.struct(*values)
    kind = right.select(held.alias("v")).schema["v"].dataType
    own = left.select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[order].dataType).alias("__order"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(kind).alias("__held"))
    other = right.where(F.col(time).isNotNull()).select(F.col(key).alias("__key"), F.col(time).alias("__time"), F.lit(0).alias("__side"), F.col(order).alias("__order"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"), held.alias("__held"))
    w = Window.partitionBy("__key").orderBy("__time", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    found = own.unionByName(other).withColumn("__held", F.last("__held", ignorenulls=True).over(w)).where("__side = 1")
    return found.select("__row.*", *[F.when(F.col("__time").isNotNull() & F.col("__key").isNotNull(), F.col(f"__held.{v}")).alias(v) for v in values])
