"""decode, encode, annotate and size as operators over DataFrames.

decode and encode work on whole Arrow batches in numpy (batch_decode, batch_encode): measured, that
takes a tenth of the time of the same layout as Column expressions, which have to go through hex
digits. What a query reads of a message only in part, by fixed positions, is better read by
fields(): Column expressions that Catalyst prunes and pushes filters through. FAILFAST (the
default) stops the job at the first message that doesn't fit; PERMISSIVE returns null for it and
fills an error column."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import CodecError
from ..functions import binary
from ..schema.model import Schema
from .batch_decode import BatchDecoder, Unsupported
from .batch_encode import BatchEncoder
from .columns import NativeDecoder, NotNative, hex_message
from .decode_local import Decoder
from .encode_local import Encoder
from .layout import static_bits
from .types import DEPTH, plain, spark_type, tagged

FAILFAST, PERMISSIVE = "FAILFAST", "PERMISSIVE"
ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("position", T.LongType()), T.StructField("context", T.StringType())])


@functools.lru_cache(maxsize=64)
def _decoder(key: str, root: str, verify: bool, strict: bool, depth: int = DEPTH) -> tuple:
    schema = _schema(key)
    return Decoder(schema, root, verify, strict), plain(schema, root, depth), BatchDecoder(schema, root, verify, strict, depth)


@functools.lru_cache(maxsize=64)
def _encoder(key: str, root: str) -> tuple:
    schema = _schema(key)
    return Encoder(schema, root), tagged(schema, root), BatchEncoder(schema, root)


@functools.lru_cache(maxsize=64)
def _schema(key: str) -> Schema:
    return Schema(**json.loads(key))


def _key(schema: Schema) -> str:
    """A schema as text: what a worker caches its compiled form by."""
    return json.dumps({"types": schema.types, "endianness": schema.endianness, "bit_order": schema.bit_order})


def arrow_decoder(schema: Schema, root: str, mode: str = FAILFAST, verify: bool = False, strict: bool = False, depth: int = DEPTH):
    """A function of a binary Column: struct(value, error), decoded in Arrow batches. It is declared
    nondeterministic, which it isn't: else a filter on a decoded field is pushed below it, and every
    message is decoded twice."""
    key, out = _key(schema), result_type(schema, root, depth)
    kind = to_arrow_type(out)

    @F.arrow_udf(out)
    def run(data: pa.Array) -> pa.Array:
        return decoded_batch(data, _decoder(key, root, verify, strict, depth), kind, mode)

    return run.asNondeterministic()


def result_type(schema: Schema, root: str, depth: int = DEPTH) -> T.StructType:
    return T.StructType([T.StructField("value", spark_type(schema, root, (), depth)), T.StructField("error", ERROR)])


def decoded_batch(data: pa.Array, by: tuple, kind: pa.DataType, mode: str) -> pa.Array:
    """struct(value, error) of a batch of messages: all at once, and one by one those that are odd."""
    decoder, convert, batch = by
    own = np.flatnonzero(pc.is_valid(data).to_numpy(zero_copy_only=False)) if data.null_count else np.arange(len(data))
    some = data if len(own) == len(data) else data.take(pa.array(own))
    try:
        values, odd = batch.decode(some)
    except Unsupported:
        values, odd = pa.array([], kind.field(0).type), np.ones(len(some), bool)
    rows, errors = [], []
    singly = np.flatnonzero(odd)
    for i in singly.tolist():
        try:
            rows.append(convert(decoder.decode(some[i].as_py())))
            errors.append(None)
        except (CodecError, KeyError, RecursionError) as e:
            if mode == FAILFAST:
                raise
            code = e.code if isinstance(e, CodecError) else "STACK_OVERFLOW" if isinstance(e, RecursionError) else "SCHEMA_MISMATCH"
            rows.append(None)
            errors.append({"code": code, "position": getattr(e, "position", None), "context": str(e)})
    at, fault = np.full(len(data), -1), np.full(len(data), -1)
    at[own] = np.arange(len(some))
    at[own[singly]] = len(values) + np.arange(len(singly))
    fault[own[singly]] = np.arange(len(singly))
    if len(singly) or len(own) < len(data):
        values = pa.concat_arrays([values, pa.array(rows, kind.field(0).type)]).take(pa.array(at, mask=at < 0))
    wrong = pa.array(errors, kind.field(1).type).take(pa.array(fault, mask=fault < 0)) if any(errors) else pa.nulls(len(data), kind.field(1).type)
    return pa.StructArray.from_arrays([values, wrong], fields=list(kind), mask=pa.array(at < 0))


def decode(df: DataFrame, column: str, schema: Schema, root: str, out: str = "decoded", mode: str = FAILFAST, verify: bool = False, strict: bool = False, native: bool = False, depth: int = DEPTH) -> DataFrame:
    """df with the messages in `column` decoded to `out`, and with PERMISSIVE `<out>_error`. A null
    message gives null. depth: how deep types within themselves are unrolled; a value that is
    nested deeper is an error. native: by Column expressions; NotNative where there are none."""
    if native:
        if verify or strict or mode != FAILFAST:
            raise NotNative("checks and error columns")
        return _native(df, column, schema, root, out)
    result = arrow_decoder(schema, root, mode, verify, strict, depth)(F.col(f"`{column}`"))
    held = "__bitloom_result"
    got = df.withColumn(held, result).withColumn(out, F.col(held)["value"])
    return (got.withColumn(f"{out}_error", F.col(held)["error"]) if mode == PERMISSIVE else got).drop(held)


def _native(df: DataFrame, column: str, schema: Schema, root: str, out: str) -> DataFrame:
    df, value, need, helpers = NativeDecoder(schema).message(df, column, root)
    data = F.col(f"`{column}`")
    short = F.raise_error(F.concat(F.lit("INCOMPLETE_DATA: "), F.coalesce(need.cast("string"), F.lit("more")), F.lit(" bytes are wanted, there are "), F.octet_length(data).cast("string")))
    checked = F.when(data.isNull(), F.lit(None)).when(F.coalesce(F.octet_length(data) < need, F.lit(True)), short).otherwise(value)
    return df.withColumn(out, checked).drop(*helpers)


def fields(df: DataFrame, column: str, schema: Schema, root: str, prefix: str = "") -> DataFrame:
    """df with the message's top-level fields as columns, natively decoded. Each column is an
    expression of its own, so Catalyst drops fields that nothing reads and pushes filters on one
    field below the others. A null message gives nulls. Raises NotNative."""
    got, value, need, helpers = NativeDecoder(schema).message(df, column, root)
    size = F.octet_length(F.col(f"`{column}`"))
    short = F.raise_error(F.concat(F.lit("INCOMPLETE_DATA: there are only "), size.cast("string"), F.lit(" bytes")))
    names = [f.name for f in spark_type(schema, root)]
    return got.withColumns({prefix + n: F.when(size < need, short).otherwise(value.getField(n)) for n in names}).drop(*helpers)


def is_native(schema: Schema, root: str, df: DataFrame, column: str) -> bool:
    try:
        NativeDecoder(schema).message(df, column, root)
        return True
    except NotNative:
        return False


def encode(df: DataFrame, value: Column | str, schema: Schema, root: str, out: str = "encoded", native: bool = False) -> DataFrame:
    """df with the struct `value` encoded to the binary column `out`. Unions are structs of `type`
    and a field per variant; fields that are null are left out; computed ones aren't given. native:
    by Column expressions; NotNative where there are none."""
    value = F.col(value) if isinstance(value, str) else value
    if native:
        return df.withColumn(out, binary.once(F.when(value.isNotNull(), F.unhex(hex_message(schema, root, value)))))
    return df.withColumn(out, arrow_encoder(schema, root)(value))


def arrow_encoder(schema: Schema, root: str):
    """A function of a struct Column: the messages, encoded in Arrow batches. Declared
    nondeterministic for the same reason as arrow_decoder."""
    key = _key(schema)

    @F.arrow_udf(T.BinaryType())
    def run(values: pa.Array) -> pa.Array:
        return encoded_batch(values, _encoder(key, root))

    return run.asNondeterministic()


def encoded_batch(values: pa.Array, by: tuple) -> pa.Array:
    encoder, convert, batch = by
    try:
        if not values.null_count:
            return batch.encode(values)
        there = pc.is_valid(values).to_numpy(zero_copy_only=False)
        at = np.cumsum(there) - 1
        return batch.encode(values.filter(pa.array(there))).take(pa.array(at, mask=~there))
    except Unsupported:
        return pa.array([None if v is None else encoder.encode(convert(v)) for v in (x.as_py() for x in values)], pa.binary())


def assemble(df: DataFrame, key: str, order: list[str], value: Column, schema: Schema, root: str, array: str, out: str = "encoded") -> DataFrame:
    """key and a message per key, from a row per item: `value` is the message's struct with one item
    in the place of the list `array`; the list has the items of all rows of the key by `order`, the
    other fields are those of the first row. Rows are shuffled and sorted as they are, and lists are
    cut out of the sorted columns: no list passes through an aggregate. Memory holds a batch and the
    items of one message. Rows with a null key make a message of their own."""
    own = _key(schema)
    rows = df.select(F.col(key), value.alias("value"), *[F.col(c).alias(f"__order_{k}") for k, c in enumerate(order)])
    sorted_ = rows.repartition(F.col(key)).sortWithinPartitions(key, *[f"__order_{k}" for k in range(len(order))]).select(key, "value")
    kind = T.StructType([rows.schema[key], T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [key, out], None

        def messages(keys: pa.Array, values: pa.StructArray, starts: np.ndarray) -> pa.RecordBatch:
            at = np.append(starts, len(keys)).astype(np.int32)
            first = pa.array(starts)
            fields = [pa.ListArray.from_arrays(pa.array(at), v) if f.name == array else v.take(first) for f, v in zip(values.type, values.flatten())]
            whole = pa.StructArray.from_arrays(fields, [f.name for f in values.type])
            return pa.RecordBatch.from_arrays([keys.take(first), encoded_batch(whole, _encoder(own, root))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column(0), batch.column(1)
            differs = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)), False)
            gap = pc.xor(pc.is_null(keys.slice(1)), pc.is_null(keys.slice(0, len(keys) - 1)))
            starts = 1 + np.flatnonzero(pc.or_(differs, gap).to_numpy(zero_copy_only=False))
            if held is not None and held[0][0][0] != keys[0]:
                starts = np.r_[0, starts]
            if not len(starts):  # all rows go on with the message that is held
                held = ([], []) if held is None else held
                held[0].append(keys)
                held[1].append(values)
                continue
            last = int(starts[-1])
            before = sum(map(len, held[0])) if held else 0
            heads = ([*held[0], keys.slice(0, last)], [*held[1], values.slice(0, last)]) if held else ([keys.slice(0, last)], [values.slice(0, last)])
            yield messages(pa.concat_arrays(heads[0]), pa.concat_arrays(heads[1]), np.r_[0, before + starts[:-1]])
            held = [keys.slice(last)], [values.slice(last)]
        if held is not None:
            yield messages(pa.concat_arrays(held[0]), pa.concat_arrays(held[1]), np.zeros(1, np.int64))

    return sorted_.mapInArrow(run, kind)


def encoded_size(df: DataFrame, value: Column | str, schema: Schema, root: str, out: str = "size") -> DataFrame:
    """df with the bytes that `value` takes on the wire. A type of one size needs no value; else
    messages are laid out where the values are, and only their sizes come back."""
    value = F.col(value) if isinstance(value, str) else value
    bits = static_bits(schema, root)
    if bits is not None:
        return df.withColumn(out, F.when(value.isNotNull(), F.lit(-(-bits // 8)).cast("long")))
    key = _key(schema)

    @F.arrow_udf(T.LongType())
    def run(values: pa.Array) -> pa.Array:
        return pc.binary_length(encoded_batch(values, _encoder(key, root))).cast(pa.int64())

    return df.withColumn(out, run.asNondeterministic()(value))


def messages(df: DataFrame, decoded: str, union: str, variant: str) -> DataFrame:
    """Route: the rows whose union field has this variant, with the variant's fields as columns."""
    u = F.col(f"{decoded}.{union}")
    return df.where(u["type"] == variant).select(*[c for c in df.columns if c != decoded], u[variant].alias("__v")).select(*[c for c in df.columns if c != decoded], "__v.*")


def items(df: DataFrame, column: str, schema: Schema, root: str, array: str) -> DataFrame:
    """A row per item of an array field: index and item beside the other columns."""
    got = decode(df, column, schema, root, "__message")
    return got.select(*[c for c in df.columns if c != column], F.posexplode(F.col(f"__message.{array}")).alias("index", "item"))


ANNOTATION = "offset long, length long, bit int, bits int, path string, type string, value string"


def annotate(df: DataFrame, column: str, schema: Schema, root: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per field of each message: where it lies on the wire, its path, type and value."""
    key = _key(schema)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    names = [*carry, *[x.split()[0] for x in ANNOTATION.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .annotate import spans

        schema_ = _schema(key)
        for batch in batches:
            rows, owner = [], []
            for i, x in enumerate(batch.column(len(carry))):
                if x.as_py() is not None:
                    own = spans(schema_, root, x.as_py())
                    rows += own
                    owner += [i] * len(own)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            kept = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names)

    return df.select(*carry, F.col(f"`{column}`")).mapInArrow(run, f"{fields}, {ANNOTATION}" if carry else ANNOTATION)


def register(spark: SparkSession, name: str, schema: Schema, root: str, mode: str = FAILFAST) -> None:
    """SQL function name(binary) -> struct(value, error)."""
    spark.udf.register(name, arrow_decoder(schema, root, mode))


def register_items(spark: SparkSession, name: str, schema: Schema, root: str, array: str) -> None:
    """SQL table function name(binary): a row (index, item) per item of an array field."""
    key, inner = _key(schema), spark_type(schema, root)
    out = T.StructType([T.StructField("index", T.LongType()), T.StructField("item", inner[array].dataType.elementType)])

    class Items:
        def eval(self, message: bytes) -> Iterator[tuple]:
            if message is not None:
                decoder, convert, _ = _decoder(key, root, False, False)
                yield from enumerate(convert(decoder.decode(bytes(message)))[array])

    spark.udtf.register(name, F.udtf(Items, returnType=out))
