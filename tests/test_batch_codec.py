"""The batch codec against the local one: whatever a schema has, and messages that are odd."""

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.pandas.types import to_arrow_type

from bitloom.errors import CodecError
from bitloom.operators import codec
from bitloom.operators.batch_decode import BatchDecoder, Unsupported
from bitloom.operators.batch_encode import BatchEncoder
from bitloom.operators.decode_local import Decoder
from bitloom.operators.encode_local import Encoder
from bitloom.operators.types import plain, spark_type, tagged
from bitloom.plans.catalog import array, field, schema, seq, text


def agree(s, root, values, unsupported=()):
    """Both ways; returns the messages."""
    kind = to_arrow_type(spark_type(s, root))
    given_ = pa.array(values, kind)
    encoder, tag = Encoder(s, root), tagged(s, root)
    want = [encoder.encode(tag(v)) for v in given_.to_pylist()]
    try:
        assert BatchEncoder(s, root).encode(given_).to_pylist() == want
        assert "encode" not in unsupported
    except Unsupported:
        assert "encode" in unsupported
    got, odd = BatchDecoder(s, root, verify=True).decode(pa.array(want, pa.binary()))
    convert, decoder = plain(s, root), Decoder(s, root, True)
    right = pa.array([convert(decoder.decode(m)) for m in want], kind)
    assert got.type == kind and not odd.any()
    assert got.to_pylist() == right.to_pylist()
    return want


NUMBERS = ("uint8", "uint16", "uint32", "int8", "int16", "int32", "int64", "bool")


@pytest.mark.parametrize("little", [False, True])
def test_numbers(little):
    rng = np.random.default_rng(1)
    s = schema({"N": seq(*[field(k, k) for k in (*NUMBERS, "uint64", "float32", "float64")])}, little=little)
    draw = lambda k: bool(rng.integers(0, 2)) if k == "bool" else int(rng.integers(-(1 << int(k[3:]) - 1), (1 << int(k[3:]) - 1) - 1)) if k[0] == "i" else int(rng.integers(0, 1 << int(k[4:])))
    rows = [{k: draw(k) for k in NUMBERS} | {"uint64": Decimal(int(rng.integers(0, 1 << 64, dtype=np.uint64))), "float32": float(np.float32(rng.normal())), "float64": float(rng.normal())} for _ in range(200)]
    agree(s, "N", rows)


def test_varints():
    rng = np.random.default_rng(2)
    s = schema({"V": seq(*[field(e, "varlength", encoding=e) for e in ("leb128", "der", "ebml", "vlq")])})
    big = lambda less: Decimal(int(rng.integers(0, 1 << 64, dtype=np.uint64)) >> int(rng.integers(less, 64)))
    agree(s, "V", [{"leb128": big(0), "der": big(0), "ebml": big(9), "vlq": big(36)} for _ in range(300)])


@pytest.mark.parametrize("lsb", [False, True])
def test_bits(lsb):
    rng = np.random.default_rng(3)
    s = schema({"B": seq(field("a", "bit", size=3), field("b", "bit", size=13), field("c", "int", size=7), field("d", "bit", size=1), field("e", "bitfield", size=16, fields=[{"name": "x", "offset": 0, "size": 5}, {"name": "y", "offset": 5, "size": 11}]), field("tail", "bit", size=3))}, lsb=lsb)
    r = lambda a, b: int(rng.integers(a, b))
    agree(s, "B", [{"a": r(0, 8), "b": r(0, 8192), "c": r(-64, 64), "d": r(0, 2), "e": {"x": r(0, 32), "y": r(0, 2048)}, "tail": r(0, 8)} for _ in range(200)])


WORDS = ["", "a", "héllo", "日本語", "a𝄞b", "plain text here", "x" * 300, "ß"]


def test_texts():
    s = schema({"S": seq(text("a"), text("b", encoding="utf16"), text("c", "null_terminated"), text("d", "null_terminated", "utf16"), text("e", "fixed", length=18), text("f", "fixed", "utf16", length=6), field("n", "uint16", computed={"type": "length_of", "target": "g", "encoding": "utf8"}), field("u", "uint16", computed={"type": "length_of", "target": "g"}), text("g", "field_referenced", length_field="n"), text("h", "null_terminated", "latin1"), field("i", "bytes", kind="length_prefixed", length_type="uint16"))})
    pick = lambda k: WORDS[k % 8]
    agree(s, "S", [{"a": pick(i), "b": pick(i // 2), "c": pick(i // 3), "d": pick(i // 5), "e": pick(i % 6), "f": pick(i % 4), "g": pick(i // 7), "h": pick(i % 3), "i": pick(i).encode()} for i in range(200)])


def test_lists():
    s = schema({
        "Word": {"type": "string", "kind": "length_prefixed", "length_type": "uint8", "encoding": "ascii"}, "Step": seq(field("tag", "uint8", const=1), field("line", "uint8")), "Last": seq(field("tag", "uint8", const=255)), "Pair": seq(field("x", "uint16"), array("ys", "uint8")),
        "L": seq(array("words", "Word", "null_terminated"), array("until", "uint16", "signature_terminated", terminator_value=65535, terminator_type="uint16"), field("mark", "uint16", const=65535), array("sized", "Word", "length_prefixed_items", length_type="uint8", item_length_type="uint16"), array("steps", {"type": "choice", "choices": [{"type": "Step"}, {"type": "Last"}]}, "variant_terminated", terminal_variants=["Last"]),
                 array("grid", {"type": "array", "kind": "length_prefixed", "length_type": "uint8", "items": {"type": "uint16"}}, "byte_length_prefixed", length_type="uint16"), field("n", "uint8"), array("counted", "Pair", "computed_count", count_expr="(n + 1) * 2 / 2 - 1"), array("rest", "Pair", "eof_terminated")),
    })
    rows = [{"words": [f"w{j}" for j in range(i % 7)], "until": list(range(i % 5)), "sized": [f"q{j}" for j in range(i % 4)], "steps": [{"type": "Step", "Step": {"line": j}} for j in range(i % 6)] + [{"type": "Last", "Last": {}}], "grid": [[j, j + 1][: j % 3] for j in range(i % 5)], "n": i % 3, "counted": [{"x": 1, "ys": [i % 9]}] * (i % 3), "rest": [{"x": 2, "ys": [9] * j} for j in range(i % 4)]} for i in range(120)]
    agree(s, "L", rows)


def test_a_few_long_lists_among_short_ones():
    s = schema({"Word": {"type": "string", "kind": "length_prefixed", "length_type": "uint8", "encoding": "ascii"}, "L": seq(array("words", "Word"))})
    key = codec._key(s)
    kind = to_arrow_type(codec.result_type(s, "L"))
    values = [{"words": ["ab"] * n} for n in (1, 3000, 2, 0)]
    wire = pa.array([Encoder(s, "L").encode(v) for v in values], pa.binary())
    assert [r["value"] for r in codec.decoded_batch(wire, codec._decoder(key, "L", False, False), kind, codec.FAILFAST).to_pylist()] == values


def test_computed_fields():
    s = schema({
        "Back": seq(field("tag", "uint8", const=1), field("line", "uint8"), field("part", "uint32")), "Kept": seq(field("tag", "uint8", const=2), field("line", "uint16")),
        "Sum": seq(field("first", "uint32", computed={"type": "position_of", "target": "../rows[first<Back>]"}), field("last", "uint32", computed={"type": "position_of", "target": "../rows[last<Kept>]"}), field("back", "uint32", computed={"type": "sum_of_type_sizes", "target": "../rows", "element_type": "Back"})),
        "Bill": seq(field("before", "uint8"), array("rows", {"type": "choice", "choices": [{"type": "Back"}, {"type": "Kept"}]}), field("sum", "Sum"), field("crc", "uint32", computed={"type": "crc32_of", "target": "raw"}), field("raw", "bytes", kind="length_prefixed", length_type="uint8"), field("at", "uint16", computed={"type": "position_of", "target": "raw"}), field("both", "uint16", computed={"type": "sum_of_sizes", "targets": ["rows", "raw"]}), field("n", "uint16", computed={"type": "count_of", "target": "rows"}), field("size", "uint16", computed={"type": "length_of", "target": "sum", "offset": 3})),
    })
    agree(s, "Bill", [{"before": 1, "rows": [{"type": "Back", "Back": {"line": j, "part": j * 7}} if (i + j) % 3 else {"type": "Kept", "Kept": {"line": j}} for j in range(i % 6)], "sum": {}, "raw": b"abc" * (i % 9)} for i in range(100)])
    der = lambda n: field(n, "varlength", encoding="der", computed={"type": "length_of", "from_after_field": n})
    s = schema({"In": seq(field("tag", "uint8", const=27), der("n"), text("t", "field_referenced", length_field="n")), "Out": seq(field("tag", "uint8", const=48), der("m"), field("inner", "In"))})
    agree(s, "Out", [{"inner": {"t": "z" * i}} for i in range(0, 400, 7)])


def test_optional_union_reference_and_position():
    s = schema({
        "Kind": {"type": "enum", "repr": "uint8", "variants": {"a": 1, "b": 2, "c": 9}}, "Fix": seq(field("n", "int16")), "Raw": seq(array("data", "uint8", "eof_terminated")),
        "E": seq(field("kind", "Kind"), field("flags", "uint8"), field("high", "uint32", conditional="flags & 0x01"), field("who", "optional", value_type="uint64"), text("opt", "length_prefixed", conditional="kind == 9 && flags >= 1"), field("size", "uint8", computed={"type": "length_of", "target": "body"}), field("body", "discriminated_union", discriminator={"field": "kind"}, byte_budget={"field": "size"}, variants=[{"when": "value == 2", "type": "Fix"}, {"type": "Raw"}]), field("p", "padding", align_to=4), field("end", "uint8")),
    })
    names = ["a", "b", "c"]
    agree(s, "E", [{"kind": names[i % 3], "flags": i % 3, "high": i if i % 3 & 1 else None, "who": Decimal(i) if i % 4 else None, "opt": "abc"[: i % 4] if i % 3 == 2 else None, "body": {"type": "Fix", "Fix": {"n": -i}} if i % 3 == 1 else {"type": "Raw", "Raw": {"data": list(range(i % 9))}}, "end": 7} for i in range(120)])
    s = schema({
        "Word": {"type": "string", "kind": "length_prefixed", "length_type": "uint8", "encoding": "ascii"}, "Seen": {"type": "back_reference", "storage": "uint16", "offset_mask": "0x7FFF", "offset_from": "message_start", "target_type": "Word"},
        "Either": {"type": "discriminated_union", "discriminator": {"peek": "uint8"}, "variants": [{"when": "value >= 0x80", "type": "Seen"}, {"type": "Word"}]}, "P": seq(field("a", "Either"), field("b", "Either")),
    })
    agree(s, "P", [{"a": {"type": "Word", "Word": "w" * (i % 5)}, "b": {"type": "Seen", "Seen": "w" * (i % 5)}} for i in range(50)], unsupported=("encode",))
    s = schema({"Row": seq(field("c", "uint32")), "File": seq(field("magic", "uint16", const=0xBEE5), field("at", "uint32"), field("z", "uint64"), instances=[{"name": "row", "type": "Row", "position": "at", "alignment": 2}, {"name": "foot", "type": "uint16", "position": -2}])})
    agree(s, "File", [{"at": i % 5 * 2, "z": Decimal(i * 7919)} for i in range(50)])


ODD = schema({"Kind": {"type": "enum", "repr": "uint8", "variants": {"A": 1, "B": 2}}, "M": seq(field("kind", "Kind"), text("t", "length_prefixed"), array("ns", "uint16", "length_prefixed"), field("end", "uint8", const=7))})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=24), st.tuples(st.sampled_from("AB"), st.text(max_size=4), st.lists(st.integers(0, 65535), max_size=3))), max_size=8), st.booleans())
def test_odd_messages(messages, verify):
    """Null, cut, garbled and sound messages in one batch, each with its own value or error."""
    encoder = Encoder(ODD, "M")
    wire = [encoder.encode({"kind": m[0], "t": m[1], "ns": m[2]}) if isinstance(m, tuple) else m for m in messages]
    decoder, convert = Decoder(ODD, "M", verify), plain(ODD, "M")
    want = []
    for m in wire:
        try:
            want.append(None if m is None else ({"value": convert(decoder.decode(m))}, None))
        except CodecError as e:
            want.append((None, (e.code, e.position)))
    got = codec.decoded_batch(pa.array(wire, pa.binary()), codec._decoder(codec._key(ODD), "M", verify, False), to_arrow_type(codec.result_type(ODD, "M")), codec.PERMISSIVE).to_pylist()
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None:
            assert g is None
        elif w[1] is None:
            assert g["error"] is None and g["value"] == w[0]["value"]
        else:
            assert g["value"] is None and (g["error"]["code"], g["error"]["position"]) == w[1]


def test_missing_values_are_errors_on_every_path(spark):
    """A null in a required field stops the job, whichever path encodes."""
    s = schema({"R": seq(field("a", "uint16"), field("flag", "bit", size=1), field("rest", "bit", size=7), text("t"))})
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 1, "x")], "a int, flag int, t string")
    for hole in ("a", "flag", "t"):
        v = F.struct(*[F.lit(None).cast(k).alias(c) if c == hole else F.col(c) for c, k in (("a", "int"), ("flag", "int"), ("t", "string"))], F.lit(0).alias("rest"))
        for native in (True, False):
            with pytest.raises(Exception, match="SCHEMA_MISMATCH"):
                codec.encode(rows, v, s, "R", native=native).collect()


def test_assemble(spark):
    """Messages from item rows, with a message that spans many batches and rows without a key."""
    from pyspark.sql import functions as F

    s = schema({"Bag": seq(field("key", "int64"), field("items", "array", kind="length_prefixed", length_type="uint32", items={"type": "uint32"}))})
    rows = spark.range(0, 30000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") < 29000, F.col("id") % 50).alias("k"), "id")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        w = codec.assemble(rows, "k", ["id"], F.struct(F.coalesce("k", F.lit(-1)).cast("long").alias("key"), F.col("id").alias("items")), s, "Bag", "items", "w")
        got = {r.k: list(r.items_) for r in codec.decode(w, "w", s, "Bag", "m").select("k", F.col("m.items").alias("items_")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want: dict = {}
    for i in range(30000):
        want.setdefault(7 if i % 3 == 0 else i % 50 if i < 29000 else None, []).append(i)
    assert got == want


def test_native_plans_stay_small(spark):
    """A filter on one field doesn't copy what the message was made from, or where fields start."""
    from pyspark.sql import functions as F

    s = schema({"Click": seq(field("user", "uint32")), "Raw": seq(array("data", "uint8", "eof_terminated")), "Chunk": seq(text("id", "fixed", "ascii", length=8), field("size", "uint32"), field("body", "discriminated_union", discriminator={"field": "id"}, byte_budget={"field": "size"}, variants=[{"when": "value == 'click'", "type": "Click"}, {"type": "Raw"}]), field("end", "uint8"))})
    w = spark.createDataFrame([(bytearray(b"click\0\0\0\0\0\0\4\0\0\0\2\7"),)], "w binary")
    m = codec.decode(w, "w", s, "Chunk", "m", native=True).where("m.end = 7")
    assert m.select("m.body.Click.user").collect()[0][0] == 2
    assert len(m._jdf.queryExecution().optimizedPlan().toString()) < 20000
    plan = codec.fields(codec.encode(w, F.struct(F.lit("click").alias("id"), F.lit(0).alias("size"), F.struct(F.lit("Raw").alias("type"), F.struct(F.lit(1).alias("user")).alias("Click"), F.struct(F.array(F.lit(1)).alias("data")).alias("Raw")).alias("body"), F.lit(7).alias("end")), s, "Chunk", "x", native=True), "x", s, "Chunk").where("id = 'click'")
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 20000
