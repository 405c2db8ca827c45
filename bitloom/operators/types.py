"""The Spark type of a schema type, and the conversion of decoded values to it.

Spark has no sum type: a union is a struct of `type` and one nullable field per variant. Types that
contain themselves are unrolled `depth` times; below that a value is an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import types as T

from ..errors import CodecError
from ..schema.model import Schema

DEPTH = 4
SIMPLE = {"uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "bool": T.BooleanType(), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}


def variants(f: dict) -> list[str]:
    return list(dict.fromkeys(v["type"] for v in f.get("variants") or f.get("choices")))


def spark_type(schema: Schema, spec: dict | str, open_: tuple = (), depth: int = DEPTH) -> T.DataType | None:
    """None where a type is unrolled no further, and for padding."""
    if isinstance(spec, str) or spec.get("type") in schema.types:
        name = spec if isinstance(spec, str) else spec["type"]
        if name not in schema.types:
            return spark_type(schema, {"type": name}, open_, depth)
        if open_.count(name) >= (depth if name in open_ else 1) and name in open_:
            return None
        own = schema.types[name]
        if "sequence" not in own:
            return T.StringType() if own.get("type") == "enum" else spark_type(schema, own, (*open_, name), depth)
        fields = []
        for f in [*own["sequence"], *own.get("instances", [])]:
            kind = f["type"] if not isinstance(f["type"], dict) else {"type": "discriminated_union", **f["type"]}
            t = spark_type(schema, kind if isinstance(kind, dict) else f, (*open_, name), depth)
            if t is not None:
                fields.append(T.StructField(f["name"], t))
        return T.StructType(fields)
    kind = spec["type"]
    if kind in SIMPLE:
        return SIMPLE[kind]
    if kind in ("bit", "int", "varlength"):
        return T.DecimalType(20, 0) if kind == "varlength" or kind == "bit" and spec.get("size", 1) == 64 else T.LongType()
    if kind == "bitfield":
        return T.StructType([T.StructField(x["name"], T.LongType()) for x in spec["fields"]])
    if kind == "array":
        inner = spark_type(schema, spec["items"], open_, depth)
        return T.ArrayType(inner) if inner is not None else None
    if kind == "optional":
        return spark_type(schema, spec["value_type"], open_, depth)
    if kind == "back_reference":
        return spark_type(schema, spec["target_type"], open_, depth)
    if kind in ("discriminated_union", "choice"):
        own = [(n, spark_type(schema, n, open_, depth)) for n in variants(spec)]
        return T.StructType([T.StructField("type", T.StringType()), *[T.StructField(n, t) for n, t in own if t is not None]])
    return None



def plain(schema: Schema, spec: dict | str, depth: int = DEPTH, open_: tuple = ()) -> Callable:
    """Decoded value -> value of spark_type: unions become {"type", variant: value}."""
    if isinstance(spec, str) or spec.get("type") in schema.types:
        name = spec if isinstance(spec, str) else spec["type"]
        if name in schema.types:
            if name in open_ and open_.count(name) >= depth:

                def stop(v: object) -> object:
                    raise CodecError("CIRCULAR_REFERENCE", f"{name} is nested more than {depth} times")

                return stop
            own = schema.types[name]
            if "sequence" not in own:
                return (lambda v: v) if own.get("type") == "enum" else plain(schema, own, depth, (*open_, name))
            steps = {}
            for f in [*own["sequence"], *own.get("instances", [])]:
                kind = f["type"] if not isinstance(f["type"], dict) else {"type": "discriminated_union", **f["type"]}
                step = plain(schema, kind if isinstance(kind, dict) else f, depth, (*open_, name))
                if step is not _same:
                    steps[f["name"]] = step
            if not steps:
                return _same
            return lambda v: {k: steps[k](x) if k in steps else x for k, x in v.items()}
        return plain(schema, {"type": name}, depth, open_)
    kind = spec["type"]
    if kind == "array":
        inner = plain(schema, spec["items"], depth, open_)
        return _same if inner is _same else lambda v: [inner(x) for x in v]
    if kind in ("optional", "back_reference"):
        return plain(schema, spec.get("value_type") or spec["target_type"], depth, open_)
    if kind in ("discriminated_union", "choice"):
        own = {n: plain(schema, n, depth, open_) for n in variants(spec)}
        if kind == "choice":
            return lambda v: {"type": v["type"], v["type"]: own[v["type"]]({k: x for k, x in v.items() if k != "type"})}
        return lambda v: {"type": v["type"], v["type"]: own[v["type"]](v["value"])}
    return _number if kind == "uint64" or kind == "varlength" or kind == "bit" and spec.get("size", 1) == 64 else _same


def _number(v: object) -> object:
    from decimal import Decimal

    return Decimal(v)


def _same(v: object) -> object:
    return v


def tagged(schema: Schema, spec: dict | str) -> Callable:
    """The inverse of plain, for rows on their way to the encoder; null fields are left out."""
    if isinstance(spec, str) or spec.get("type") in schema.types:
        name = spec if isinstance(spec, str) else spec["type"]
        if name in schema.types:
            own = schema.types[name]
            if "sequence" not in own:
                return (lambda v: v) if own.get("type") == "enum" else tagged(schema, own)
            steps: dict = {}

            def convert(v: dict) -> dict:
                if not steps:
                    steps.update({f["name"]: tagged(schema, f) for f in own["sequence"] if "name" in f})
                return {k: steps[k](x) for k, x in v.items() if x is not None and k in steps}

            return convert
        return tagged(schema, {"type": name})
    kind = spec["type"]
    if kind == "array":
        inner = tagged(schema, spec["items"])
        return lambda v: [inner(x) for x in v]
    if kind in ("optional", "back_reference"):
        return tagged(schema, spec.get("value_type") or spec["target_type"])
    if kind in ("discriminated_union", "choice"):
        own_: dict = {}

        def pick(v: dict) -> dict:
            if not own_:
                own_.update({n: tagged(schema, n) for n in variants(spec)})
            if v["type"] not in own_:
                raise CodecError("INVALID_VARIANT", f"{v['type']!r} is no variant")
            inner = own_[v["type"]](v.get(v["type"]) if v.get(v["type"]) is not None else {})
            return {**inner, "type": v["type"]} if kind == "choice" else {"type": v["type"], "value": inner}

        return pick
    return (lambda v: int(v)) if kind in ("uint64", "varlength", "bit") else _same
