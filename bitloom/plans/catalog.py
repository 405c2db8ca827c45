"""The engine's registered queries: messages are built from table columns, decoded, and queried.
Each has SQL that must give the same rows without any wire format in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary
from ..operators import codec, relational
from ..schema.model import Schema, load
from ..sources import files
from ..streaming import framing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "fixed_records"


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SPREAD = (1 << 20, 128 << 20)  # bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A small table of one row group is read by one task; as decoding costs more than moving its
    few megabytes, it is spread over all cores. Larger tables are read where they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # By a column's hash: dealing rows out in turn sorts them all first.
    return df.repartition(spark.sparkContext.defaultParallelism, df.columns[0]) if SPREAD[0] <= size <= SPREAD[1] else df


def schema(types: dict, little: bool = False, lsb: bool = False, protocol: dict | None = None) -> Schema:
    raw = {"config": {"endianness": "little_endian" if little else "big_endian", "bit_order": "lsb_first" if lsb else "msb_first"}, "types": types}
    return load(raw | ({"protocol": protocol} if protocol else {}))


def field(name: str, type_: str, **more) -> dict:
    return {"name": name, "type": type_, **more}


def seq(*fields: dict, **more) -> dict:
    return {"sequence": list(fields), **more}


def text(name: str, kind: str = "length_prefixed", encoding: str = "utf8", **more) -> dict:
    return field(name, "string", kind=kind, encoding=encoding, **({"length_type": "uint32"} if kind == "length_prefixed" else {}), **more)


def array(name: str, items: dict | str, kind: str = "length_prefixed", **more) -> dict:
    return field(name, "array", kind=kind, items=items if isinstance(items, dict) else {"type": items}, **({"length_type": "uint16"} if kind == "length_prefixed" else {}), **more)


def round_trip(df: DataFrame, s: Schema, root: str, value, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and `m`, the message that value was encoded to and decoded from."""
    return codec.decode(codec.encode(df, value, s, root, "wire").select(*keep, "wire"), "wire", s, root, "m")


# Primitives ---------------------------------------------------------------------------------------

LINE = schema({"Line": seq(field("orderkey", "int64"), field("partkey", "uint32"), field("line", "uint8"), field("quantity", "int32"), field("cents", "int64"), text("flag", "fixed", "ascii", length=1), text("status", "fixed", "ascii", length=1))})


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    value = F.struct(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return codec.encode(li, value, LINE, "Line", "wire").select("wire")


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS quantity,
          CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(max(l_orderkey) AS BIGINT) AS last_order
          FROM lineitem GROUP BY 1, 2""")
def fixed_records(spark, sf_dir):
    m = codec.decode(_lines(spark, sf_dir), "wire", LINE, "Line", "m").select("m.*")
    return m.groupBy("flag", "status").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.sum("cents").alias("cents"), F.max("orderkey").alias("last_order"))


@query("""SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 3""")
def filter_before_payload(spark, sf_dir):
    m = codec.fields(_lines(spark, sf_dir), "wire", LINE, "Line")
    return m.where("flag = 'R' and line > 3").agg(F.count("*").alias("n"), F.sum("orderkey").alias("keys"))


@query("""SELECT o_orderkey, lower(lpad(to_hex(o_orderkey % 65536), 4, '0')) AS be16, lower(lpad(to_hex(o_custkey), 8, '0')) AS be32,
          lower(lpad(to_hex(o_custkey % 256), 2, '0') || lpad(to_hex((o_custkey // 256) % 256), 2, '0')) AS le16 FROM orders""")
def wire_image(spark, sf_dir):
    s = schema({"W": seq(field("a", "uint16"), field("b", "uint32"), field("c", "uint16", endianness="little_endian"))})
    o = table(spark, sf_dir, "orders")
    w = codec.encode(o, F.struct((F.col("o_orderkey") % 65536).alias("a"), F.col("o_custkey").alias("b"), (F.col("o_custkey") % 65536).alias("c")), s, "W", "wire")
    h = F.lower(F.hex("wire"))
    return w.select("o_orderkey", F.substring(h, 1, 4).alias("be16"), F.substring(h, 5, 8).alias("be32"), F.substring(h, 13, 4).alias("le16"))


INTS = {f"{s}{n}": f"{s}int{n}" for s in ("u", "") for n in (8, 16, 32, 64)}


@query("""SELECT o_orderkey, CAST(o_custkey % 256 AS BIGINT) AS u8, CAST(o_custkey AS BIGINT) AS u32, CAST(o_orderkey % 256 - 128 AS BIGINT) AS i8,
          CAST(-o_custkey AS BIGINT) AS i32, CAST(-o_orderkey * 1000003 AS BIGINT) AS i64, CAST(o_orderkey AS VARCHAR) AS u64 FROM orders""")
def integers(spark, sf_dir):
    s = schema({"I": seq(field("u8", "uint8"), field("u32", "uint32"), field("i8", "int8"), field("i32", "int32", endianness="big_endian"), field("i64", "int64"), field("u64", "uint64"))}, little=True)
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    v = F.struct((F.col("o_custkey") % 256).alias("u8"), F.col("o_custkey").alias("u32"), (k % 256 - 128).alias("i8"), (-F.col("o_custkey")).alias("i32"), (-k * 1000003).alias("i64"), k.cast("decimal(20,0)").alias("u64"))
    m = round_trip(o, s, "I", v, ("o_orderkey",))
    return m.select("o_orderkey", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("u8", "u32", "i8", "i32", "i64")], F.col("m.u64").cast("string").alias("u64"))


@query("""SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last,
          CAST(list_max(embedding) AS DOUBLE) AS most FROM embeddings""")
def floats(spark, sf_dir):
    s = schema({"V": seq(field("n", "uint16", computed={"type": "length_of", "target": "v"}), array("v", "float32", "field_referenced", length_field="n"))}, little=True)
    e = table(spark, sf_dir, "embeddings")
    w = codec.encode(e, F.struct(F.col("embedding").alias("v")), s, "V", "wire")
    m = codec.decode(w.select("vec_id", "wire"), "wire", s, "V", "m")
    return m.select("vec_id", F.col("m.n").cast("long").alias("n"), F.get("m.v", F.lit(0)).cast("double").alias("first"), F.element_at("m.v", -1).cast("double").alias("last"), F.array_max("m.v").cast("double").alias("most"))


@query("""SELECT p_partkey, p_retailprice AS price, -p_retailprice / 7 AS seventh FROM part""")
def doubles(spark, sf_dir):
    s = schema({"D": seq(field("a", "float64"), field("b", "float64", endianness="little_endian"))})
    p = table(spark, sf_dir, "part")
    m = round_trip(p, s, "D", F.struct(F.col("p_retailprice").alias("a"), (-F.col("p_retailprice") / 7).alias("b")), ("p_partkey",))
    return m.select("p_partkey", F.col("m.a").alias("price"), F.col("m.b").alias("seventh"))


@query("""SELECT o_orderkey, o_orderkey % 8 AS low, (o_orderkey >> 3) % 32 AS mid, (o_orderkey >> 8) % 256 AS high, o_custkey % 4 AS lsb,
          (o_custkey >> 2) % 1024 AS wide FROM orders""")
def bits(spark, sf_dir):
    msb = schema({"B": seq(field("high", "bit", size=8), field("mid", "bit", size=5), field("low", "bit", size=3))})
    lsb = schema({"B": seq(field("lsb", "bit", size=2), field("wide", "bit", size=10), field("rest", "bit", size=4))}, lsb=True)
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    a = codec.encode(o, F.struct((F.shiftright(k, 8) % 256).alias("high"), (F.shiftright(k, 3) % 32).alias("mid"), (k % 8).alias("low")), msb, "B", "x")
    b = codec.encode(a, F.struct((c % 4).alias("lsb"), (F.shiftright(c, 2) % 1024).alias("wide"), F.lit(0).alias("rest")), lsb, "B", "y")
    d = codec.decode(codec.decode(b, "x", msb, "B", "p"), "y", lsb, "B", "q")
    return d.select("o_orderkey", "p.low", "p.mid", "p.high", "q.lsb", "q.wide")


@query("""SELECT o_orderkey, CAST(o_custkey % 2 AS BIGINT) AS flag, CAST(o_custkey % 8 AS BIGINT) AS level, o_totalprice > 100000 AS large FROM orders""")
def bitfields(spark, sf_dir):
    s = schema({"B": seq(field("flags", "bitfield", size=8, fields=[{"name": "flag", "offset": 0, "size": 1}, {"name": "level", "offset": 1, "size": 3}, {"name": "reserved", "offset": 4, "size": 4}]), field("large", "bool"))})
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    m = round_trip(o, s, "B", F.struct(F.struct((c % 2).alias("flag"), (c % 8).alias("level"), F.lit(0).alias("reserved")).alias("flags"), (F.col("o_totalprice") > 100000).alias("large")), ("o_orderkey",))
    return m.select("o_orderkey", "m.flags.flag", "m.flags.level", "m.large")


_SIZE7 = "CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 16384 THEN 2 WHEN o_orderkey < 2097152 THEN 3 ELSE 4 END"


@query(f"""SELECT o_orderkey, CAST({_SIZE7} AS BIGINT) AS leb_bytes, CAST({_SIZE7} AS BIGINT) AS vlq_bytes,
          CAST(CASE WHEN o_orderkey < 128 THEN 1 WHEN o_orderkey < 256 THEN 2 WHEN o_orderkey < 65536 THEN 3 WHEN o_orderkey < 16777216 THEN 4 ELSE 5 END AS BIGINT) AS der_bytes,
          CAST(o_orderkey * 4 AS BIGINT) AS total, CAST(o_orderkey AS BIGINT) AS native_leb FROM orders""")
def varints(spark, sf_dir):
    s = schema({"V": seq(*[field(e, "varlength", encoding=e) for e in ("leb128", "vlq", "der", "ebml")])})
    one = {e: schema({"V": seq(field("v", "varlength", encoding=e))}) for e in ("leb128", "vlq", "der")}
    o, k = table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey").cast("decimal(20,0)")
    m = round_trip(o, s, "V", F.struct(*[k.alias(e) for e in ("leb128", "vlq", "der", "ebml")]), ("o_orderkey",))
    for e, x in one.items():
        m = codec.encode(m, F.struct(k.alias("v")), x, "V", e)
    sizes = [F.octet_length(e).cast("long").alias(n) for e, n in (("leb128", "leb_bytes"), ("vlq", "vlq_bytes"), ("der", "der_bytes"))]
    return m.select("o_orderkey", *sizes, (F.col("m.leb128") + F.col("m.vlq") + F.col("m.der") + F.col("m.ebml")).cast("long").alias("total"), binary.leb128(F.col("leb128"))["value"].alias("native_leb"))


# Strings ------------------------------------------------------------------------------------------


@query("""SELECT doc_id, md5(text) AS utf8, md5(text) AS utf16, CAST(strlen(text) AS BIGINT) AS utf8_bytes, source, substr(lang, 1, 1) AS cut, lang FROM documents""")
def strings(spark, sf_dir):
    s = schema({"S": seq(text("a"), text("b", encoding="utf16"), text("c", "null_terminated"), text("d", "fixed", length=1), text("e", "fixed", "latin1", length=6))}, little=True)
    d = table(spark, sf_dir, "documents")
    m = round_trip(d, s, "S", F.struct(F.col("text").alias("a"), F.col("text").alias("b"), F.col("source").alias("c"), F.col("lang").alias("d"), F.col("lang").alias("e")), ("doc_id",))
    return m.select("doc_id", F.md5(F.col("m.a").cast("binary")).alias("utf8"), F.md5(F.col("m.b").cast("binary")).alias("utf16"), F.octet_length("m.a").cast("long").alias("utf8_bytes"), F.col("m.c").alias("source"), F.col("m.d").alias("cut"), F.col("m.e").alias("lang"))


@query("""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_units, md5(text) AS digest FROM documents""")
def computed_lengths(spark, sf_dir):
    s = schema({"S": seq(field("n_bytes", "uint32", computed={"type": "length_of", "target": "t", "encoding": "utf8"}), field("n_units", "uint32", computed={"type": "length_of", "target": "t"}), text("t", "field_referenced", length_field="n_bytes"))})
    d = table(spark, sf_dir, "documents")
    w = codec.encode(d, F.struct(F.col("text").alias("t")), s, "S", "wire").select("doc_id", "wire")
    m = codec.decode(w, "wire", s, "S", "m")
    return m.select("doc_id", "m.n_bytes", "m.n_units", F.md5(F.col("m.t").cast("binary")).alias("digest"))


# Arrays -------------------------------------------------------------------------------------------

ITEM = seq(field("line", "uint8"), field("part", "uint32"), field("cents", "int64"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # grouping spreads it
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))


@query("""SELECT o_orderstatus AS status, count(*) AS n_items, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(max(l_partkey) AS BIGINT) AS last_part
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def item_arrays(spark, sf_dir):
    s = schema({"Item": ITEM, "Order": seq(field("key", "int64"), array("items", "Item"))})
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    w = codec.assemble(li, "l_orderkey", ["l_linenumber"], F.struct(F.col("l_orderkey").alias("key"), item.alias("items")), s, "Order", "items", "wire")
    rows = codec.items(w, "wire", s, "Order", "items")
    j = rows.join(table(spark, sf_dir, "orders"), rows.l_orderkey == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n_items"), F.sum("item.cents").alias("cents"), F.max("item.part").alias("last_part"))


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, CAST(sum(l_partkey) AS BIGINT) AS again,
          CAST(count(*) AS BIGINT) AS n_rest FROM lineitem GROUP BY 1""")
def array_kinds(spark, sf_dir):
    s = schema({"K": seq(field("n", "uint8", computed={"type": "length_of", "target": "a"}), array("a", "uint32", "field_referenced", length_field="n"), array("b", "uint32", "byte_length_prefixed", length_type="uint16"), array("two", "uint16", "fixed", length=2), array("c", "uint8", "computed_count", count_expr="(n + 1) * 2 / 2 - 1"), array("rest", "uint16", "eof_terminated"))})
    o = _orders(spark, sf_dir)
    parts, zeros = F.transform("items", lambda x: x["part"]), F.transform("items", lambda x: F.lit(0))
    v = F.struct(parts.alias("a"), parts.alias("b"), F.array(F.lit(1), F.lit(2)).alias("two"), zeros.alias("c"), F.transform("items", lambda x: x["line"].cast("int")).alias("rest"))
    w = codec.encode(o, v, s, "K", "wire").select("l_orderkey", "wire")
    m = codec.decode(w, "wire", s, "K", "m")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("l_orderkey", F.col("m.n").cast("long").alias("n"), total("m.a").alias("parts"), total("m.b").alias("again"), F.size("m.rest").cast("long").alias("n_rest"))


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_null, CAST(count(*) AS BIGINT) AS n_signed, CAST(count(*) AS BIGINT) AS n_items,
          CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1""")
def terminated_arrays(spark, sf_dir):
    s = schema({
        "Name": {"type": "string", "kind": "length_prefixed", "length_type": "uint8", "encoding": "ascii"},
        "More": seq(field("tag", "uint8", const=1), field("line", "uint8")), "End": seq(field("tag", "uint8", const=255)),
        "T": seq(array("names", "Name", "null_terminated"), array("ones", "uint16", "signature_terminated", terminator_value=65535, terminator_type="uint16"), field("mark", "uint16", const=65535), array("sized", "Name", "length_prefixed_items", length_type="uint8", item_length_type="uint16"), array("parts", {"type": "choice", "choices": [{"type": "More"}, {"type": "End"}]}, "variant_terminated", terminal_variants=["End"])),
    })
    o = _orders(spark, sf_dir)
    name = F.transform("items", lambda x: F.concat(F.lit("p"), x["part"].cast("string")))
    more = F.transform("items", lambda x: F.struct(F.lit("More").alias("type"), F.struct(x["line"].alias("line")).alias("More"), F.struct(F.lit(None).cast("int").alias("_")).alias("End")))
    end = F.array(F.struct(F.lit("End").alias("type"), F.struct(F.lit(None).cast("int").alias("line")).alias("More"), F.struct(F.lit(None).cast("int").alias("_")).alias("End")))
    v = F.struct(name.alias("names"), F.transform("items", lambda x: x["line"].cast("int")).alias("ones"), name.alias("sized"), F.concat(more, end).alias("parts"))
    m = round_trip(o, s, "T", v, ("l_orderkey",))
    lines = F.aggregate(F.filter("m.parts", lambda x: x["type"] == "More"), F.lit(0).cast("long"), lambda a, x: a + x["More"]["line"])
    return m.select("l_orderkey", F.size("m.names").cast("long").alias("n_null"), F.size("m.ones").cast("long").alias("n_signed"), F.size("m.sized").cast("long").alias("n_items"), lines.alias("lines"))


# Structure ----------------------------------------------------------------------------------------


@query("""SELECT event_id, event_type, CASE WHEN value > 50 THEN CAST(floor(value) AS BIGINT) END AS high, CASE WHEN event_type <> 'view' THEN user_id END AS who, user_id % 16 AS nibble FROM events""")
def optional_fields(spark, sf_dir):
    s = schema({
        "Kind": {"type": "enum", "repr": "uint8", "variants": {"signup": 1, "error": 2, "click": 3, "view": 4, "purchase": 9}},
        "Revised<T>": seq(field("revision", "uint8"), field("old", "T"), field("new", "T", conditional="revision >= 2")),
        "E": seq(field("kind", "Kind"), field("flags", "uint8"), field("high", "uint32", conditional="flags & 0x01"), field("who", "optional", value_type="uint64"), field("nibble", "Revised<uint8>"), field("p", "padding", align_to=4), field("end", "uint8")),
    })
    e = table(spark, sf_dir, "events")
    high = F.col("value") > 50
    v = F.struct(F.col("event_type").alias("kind"), F.when(high, 1).otherwise(2).alias("flags"), F.when(high, F.floor("value")).alias("high"), F.when(F.col("event_type") != "view", F.col("user_id")).cast("decimal(20,0)").alias("who"), F.struct(F.lit(2).alias("revision"), F.lit(0).alias("old"), (F.col("user_id") % 16).alias("new")).alias("nibble"), F.lit(7).alias("end"))
    m = round_trip(e, s, "E", v, ("event_id",))
    return m.select("event_id", F.col("m.kind").alias("event_type"), F.col("m.high").cast("long").alias("high"), F.col("m.who").cast("long").alias("who"), F.col("m.nibble.new").cast("long").alias("nibble"))


EVENT_CODES = {"signup": 1, "error": 2, "click": 3, "view": 4, "purchase": 9}


def _events_protocol() -> Schema:
    payloads = {"Signup": seq(text("props")), "Error": seq(field("level", "uint8"), text("props")), "Click": seq(field("value", "float64")), "View": seq(field("value", "float64"), text("props")), "Purchase": seq(field("cents", "uint64"))}
    return schema({"Header": seq(field("kind", "uint8"), field("user", "uint32"), field("event", "uint32")), **payloads}, protocol={"name": "events", "version": "1", "header": "Header", "discriminator": "kind", "messages": [{"code": f"0x{c:02X}", "name": n.upper(), "payload_type": n.capitalize()} for n, c in EVENT_CODES.items()]})


def _event_frames(spark: SparkSession, sf_dir: str) -> tuple[Schema, DataFrame]:
    s, e = _events_protocol(), table(spark, sf_dir, "events")
    value = F.col("value")
    payload = F.struct(F.initcap("event_type").alias("type"), F.struct("props").alias("Signup"), F.struct(F.lit(3).alias("level"), "props").alias("Error"), F.struct(value.alias("value")).alias("Click"), F.struct(value.alias("value"), "props").alias("View"), F.struct(F.round(value * 100).cast("decimal(20,0)").alias("cents")).alias("Purchase"))
    return s, codec.encode(e, F.struct(F.upper("event_type").alias("kind"), F.col("user_id").alias("user"), F.col("event_id").alias("event"), payload.alias("payload")), s, "Frame", "wire").select("event_id", "wire")


@query("""SELECT upper(event_type) AS kind, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS cents, count(CASE WHEN event_type IN ('signup', 'error', 'view') THEN props END) AS n_props,
          max(CASE WHEN event_type IN ('click', 'view') THEN value END) AS top FROM events GROUP BY 1""")
def protocol_frames(spark, sf_dir):
    s, w = _event_frames(spark, sf_dir)
    m = codec.decode(w, "wire", s, "Frame", "m")
    p = F.col("m.payload")
    return m.groupBy("m.kind").agg(F.count("*").alias("n"), F.sum(F.coalesce(p["Purchase"]["cents"].cast("long"), F.lit(0))).alias("cents"), F.count(F.coalesce(p["Signup"]["props"], p["Error"]["props"], p["View"]["props"])).alias("n_props"), F.max(F.coalesce(p["Click"]["value"], p["View"]["value"])).alias("top"))


@query("""SELECT event_id, value, props FROM events WHERE event_type = 'view'""")
def routed_messages(spark, sf_dir):
    s, w = _event_frames(spark, sf_dir)
    views = codec.messages(codec.decode(w, "wire", s, "Frame", "m"), "m", "payload", "View")
    return views.select("event_id", "value", "props")


@query("""SELECT event_type, count(*) AS n, CAST(sum(strlen(event_type)) AS BIGINT) AS name_bytes, CAST(sum(CASE WHEN event_type = 'click' THEN user_id ELSE 0 END) AS BIGINT) AS clicks FROM events GROUP BY 1""")
def byte_budgets(spark, sf_dir):
    s = schema({"Click": seq(field("user", "uint32")), "Raw": seq(array("data", "uint8", "eof_terminated")), "Chunk": seq(text("id", "fixed", "ascii", length=8), field("size", "uint32", computed={"type": "length_of", "target": "body"}), field("body", "discriminated_union", discriminator={"field": "id"}, byte_budget={"field": "size"}, variants=[{"when": "value == 'click'", "type": "Click"}, {"type": "Raw"}]), field("end", "uint8", const=255))}, little=True)
    e = table(spark, sf_dir, "events")
    raw = F.transform(F.sequence(F.lit(1), F.length("event_type")), lambda i: F.ascii(F.substring(F.col("event_type"), i, F.lit(1))))
    body = F.struct(F.when(F.col("event_type") == "click", "Click").otherwise("Raw").alias("type"), F.struct(F.col("user_id").alias("user")).alias("Click"), F.struct(raw.alias("data")).alias("Raw"))
    w = codec.encode(e, F.struct(F.col("event_type").alias("id"), body.alias("body")), s, "Chunk", "wire").select("wire")
    m = codec.decode(w, "wire", s, "Chunk", "m")
    size = F.when(F.col("m.body.type") == "Click", F.lit(5)).otherwise(F.size("m.body.Raw.data"))
    return m.where("m.end = 255").groupBy(F.col("m.id").alias("event_type")).agg(F.count("*").alias("n"), F.sum(size).alias("name_bytes"), F.sum(F.coalesce("m.body.Click.user", F.lit(0))).alias("clicks"))


@query("""SELECT n_nationkey, n_name || '.' || r_name AS name, n_name || '.' || r_name AS again, CAST(strlen(n_name) + strlen(r_name) + 2 + 2 + 1 AS BIGINT) AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey""")
def back_references(spark, sf_dir):
    """Places as texts of nation and region; a place that was written before becomes a pointer."""
    word = {"type": "string", "kind": "length_prefixed", "length_type": "uint8", "encoding": "ascii"}
    s = schema({
        "Word": word, "Place": {"type": "array", "kind": "null_terminated", "items": {"type": "Word"}},
        "Seen": {"type": "back_reference", "storage": "uint16", "endianness": "big_endian", "offset_mask": "0x7FFF", "offset_from": "message_start", "target_type": "Place"},
        "Stop": {"type": "discriminated_union", "discriminator": {"peek": "uint8"}, "variants": [{"when": "value >= 0x80", "type": "Seen"}, {"type": "Place"}]},
        "Trip": seq(field("origin", "Stop"), field("back", "Stop")),
    })
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    words, none = F.array("n_name", "r_name"), F.lit(None).cast("array<string>")
    v = F.struct(F.struct(F.lit("Place").alias("type"), none.alias("Seen"), words.alias("Place")).alias("origin"), F.struct(F.lit("Seen").alias("type"), words.alias("Seen"), none.alias("Place")).alias("back"))
    w = codec.encode(n, v, s, "Trip", "wire").select("n_nationkey", "wire")
    m = codec.decode(w, "wire", s, "Trip", "m")
    return m.select("n_nationkey", F.array_join("m.origin.Place", ".").alias("name"), F.array_join("m.back.Seen", ".").alias("again"), F.octet_length("wire").cast("long").alias("bytes"))


@query("""SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS at_offset, CAST(o_orderkey % 65536 AS BIGINT) AS at_end FROM orders""")
def position_fields(spark, sf_dir):
    s = schema({
        "Body": seq(field("customer", "uint32")), "Foot": seq(field("low", "uint16")),
        "File": seq(field("magic", "uint16", const=0xBEEF), field("offset", "uint32"), instances=[{"name": "body", "type": "Body", "position": "offset", "alignment": 4}, {"name": "foot", "type": "Foot", "position": -2}]),
    })
    layout = schema({"L": seq(field("magic", "uint16"), field("offset", "uint32"), array("gap", "uint8", "fixed", length=6), field("customer", "uint32"), field("low", "uint16"))})
    o = table(spark, sf_dir, "orders")
    v = F.struct(F.lit(0xBEEF).alias("magic"), F.lit(12).alias("offset"), F.array_repeat(F.lit(0), 6).alias("gap"), F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 65536).alias("low"))
    w = codec.encode(o, v, layout, "L", "wire").select("o_orderkey", "wire")
    m = codec.decode(w, "wire", s, "File", "m", verify=True)
    return m.select("o_orderkey", F.col("m.body.customer").cast("long").alias("at_offset"), F.col("m.foot.low").cast("long").alias("at_end"))


# Cross-record -------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, CAST(min(CASE WHEN l_returnflag = 'R' THEN before END) AS BIGINT) AS first_r, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 6 ELSE 0 END) AS BIGINT) AS r_bytes,
          CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 3 END) AS BIGINT) AS other_bytes
          FROM (SELECT *, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 6 ELSE 3 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem) GROUP BY 1""")
def selectors(spark, sf_dir):
    s = schema({
        "Returned": seq(field("tag", "uint8", const=1), field("line", "uint8"), field("part", "uint32")), "Other": seq(field("tag", "uint8", const=2), field("line", "uint16")),
        "Summary": seq(field("first", "uint32", computed={"type": "position_of", "target": "../items[first<Returned>]"}), field("returned", "uint32", computed={"type": "sum_of_type_sizes", "target": "../items", "element_type": "Returned"}), field("other", "uint32", computed={"type": "sum_of_type_sizes", "target": "../items", "element_type": "Other"})),
        "Order": seq(array("items", {"type": "choice", "choices": [{"type": "Returned"}, {"type": "Other"}]}), field("summary", "Summary")),
    })
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # assembling spreads it
    item = F.struct(F.when(F.col("l_returnflag") == "R", "Returned").otherwise("Other").alias("type"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")).alias("Returned"), F.struct(F.col("l_linenumber").alias("line")).alias("Other"))
    v = F.struct(item.alias("items"), F.struct(F.lit(None).cast("int").alias("first")).alias("summary"))
    w = codec.assemble(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], v, s, "Order", "items", "wire")
    m = codec.decode(w, "wire", s, "Order", "m").select("l_orderkey", "m.summary.*")
    absent = F.col("first") == 0xFFFFFFFF
    return m.select("l_orderkey", F.when(~absent, F.col("first") - 2).alias("first_r"), F.col("returned").alias("r_bytes"), F.col("other").alias("other_bytes"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(sum(4 + strlen(p_name)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
          FROM lineitem JOIN part ON l_partkey = p_partkey""")
def record_offsets(spark, sf_dir):
    s = schema({"R": seq(text("name"))})
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = codec.encoded_size(j, F.struct(F.col("p_name").alias("name")), s, "R", "size").withColumn("k", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return relational.offsets(r, "l_orderkey", "k", "size").select("l_orderkey", "l_linenumber", "l_partkey", "offset")


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
          SELECT a.l_orderkey, a.l_partkey AS a_part, b.l_partkey AS n_part FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.k = b.k WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'N'""")
def corresponding_records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    j = relational.corresponding(li, li, "l_orderkey", "l_returnflag", "k", "A", "N")
    return j.select(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.l_partkey").alias("a_part"), F.col("b.l_partkey").alias("n_part"))


@query("""SELECT l_orderkey, l_returnflag, CAST(sum(strlen(l_linestatus) + 5) AS BIGINT) AS size, count(*) AS records FROM lineitem GROUP BY 1, 2""")
def sizes_by_type(spark, sf_dir):
    s = schema({"R": seq(field("line", "uint8"), text("status"))})
    r = codec.encoded_size(table(spark, sf_dir, "lineitem"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("status")), s, "R", "size")
    return relational.sizes_by_type(r, "l_orderkey", "l_returnflag", "size")


@query("""SELECT doc_id, CAST(strlen(lang) AS BIGINT) AS inner_len, CAST(strlen(lang) + 2 AS BIGINT) AS outer_len, lang FROM documents""")
def content_first_lengths(spark, sf_dir):
    der = lambda n: field(n, "varlength", encoding="der", computed={"type": "length_of", "from_after_field": n})
    s = schema({"Inner": seq(field("tag", "uint8", const=0x1B), der("inner_len"), text("lang", "field_referenced", length_field="inner_len")), "Outer": seq(field("tag", "uint8", const=0x30), der("outer_len"), field("inner", "Inner"))})
    m = round_trip(table(spark, sf_dir, "documents"), s, "Outer", F.struct(F.struct("lang").alias("inner")), ("doc_id",))
    return m.select("doc_id", F.col("m.inner.inner_len").cast("long").alias("inner_len"), F.col("m.outer_len").cast("long").alias("outer_len"), F.col("m.inner.lang").alias("lang"))


# Errors, tools, sources, streams ------------------------------------------------------------------


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'INCOMPLETE_DATA' WHEN o_orderkey % 3 = 1 THEN 'INVALID_VALUE' ELSE 'ok' END AS code, count(*) AS n FROM orders GROUP BY 1""")
def permissive_errors(spark, sf_dir):
    s = schema({"Kind": {"type": "enum", "repr": "uint8", "variants": {"A": 1}}, "M": seq(field("kind", "Kind"), field("key", "uint64"))})
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    raw = F.concat(F.when(k % 3 == 1, F.unhex(F.lit("07"))).otherwise(F.unhex(F.lit("01"))), F.unhex(F.lpad(F.hex(k), 16, "0")))
    w = o.select(F.when(k % 3 == 0, binary.window(raw, 0, 5)).otherwise(raw).alias("wire"))
    m = codec.decode(w, "wire", s, "M", "m", mode=codec.PERMISSIVE)
    return m.groupBy(F.coalesce("m_error.code", F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


@query("""SELECT path, type, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes, CAST(min(off) AS BIGINT) AS least FROM (
          SELECT 'key' AS path, 'int64' AS type, 8 AS length, 0 AS off FROM orders UNION ALL SELECT 'status', 'string', 1, 8 FROM orders UNION ALL
          SELECT 'priority', 'string', 4 + strlen(o_orderpriority), 9 FROM orders) GROUP BY 1, 2""")
def annotations(spark, sf_dir):
    s = schema({"O": seq(field("key", "int64"), text("status", "fixed", "ascii", length=1), text("priority"))})
    w = codec.encode(table(spark, sf_dir, "orders"), F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), s, "O", "wire")
    a = codec.annotate(w, "wire", s, "O")
    return a.groupBy("path", "type").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min("offset").alias("least"))


@query("""SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(strlen(o_orderpriority)) AS BIGINT) AS priority_bytes FROM orders GROUP BY 1""")
def framed_chunks(spark, sf_dir):
    """Each customer's orders as one byte stream, cut into chunks of 7 bytes and put together again."""
    s = schema({"O": seq(field("key", "int64"), field("rest", "string", kind="length_prefixed", length_type="uint8", encoding="utf8"))})
    w = codec.encode(table(spark, sf_dir, "orders"), F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("rest")), s, "O", "wire")
    stream = w.groupBy("o_custkey").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", F.hex("wire").alias("h")))), lambda x: x["h"]), "")).alias("bytes"))
    cut = stream.select("o_custkey", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("bytes") - 1) / 7).cast("int"))).alias("chunk"))
    chunks = cut.select("o_custkey", "chunk", binary.window(F.col("bytes"), F.col("chunk") * 7, 7).alias("data"))
    got = framing.frames(chunks, "o_custkey", "chunk", "data", framing.Framing.greedy(s, "O")).where("error is null")
    m = codec.decode(got.select(F.col("key").alias("o_custkey"), "message"), "message", s, "O", "m")
    return m.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("m.key").alias("keys"), F.sum(F.octet_length("m.rest")).alias("priority_bytes"))


@query("""SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS head, CAST(o_orderkey % 256 AS BIGINT) AS tail FROM orders""")
def random_access(spark, sf_dir):
    s = schema({"O": seq(field("c", "uint32"), field("k", "uint64"))})
    w = codec.encode(table(spark, sf_dir, "orders"), F.struct(F.col("o_custkey").alias("c"), F.col("o_orderkey").cast("decimal(20,0)").alias("k")), s, "O", "wire").select("o_orderkey", "wire")
    p = files.slice_at(files.slice_at(w, "wire", 0, 4, "a"), "wire", -1, 1, "b")
    return p.select("o_orderkey", binary.unsigned(F.col("a"), 4).alias("head"), binary.unsigned(F.col("b"), 1).alias("tail"))


@query("""WITH r AS (SELECT l_orderkey, l_partkey, l_returnflag, l_linenumber, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
          SELECT a.l_orderkey, a.l_partkey AS at, b.l_partkey AS section FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.k * 10 >= b.k * 8 AND a.k * 10 < b.k * 8 + 8""")
def containing_sections(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("k"))
    points = r.select("l_orderkey", F.col("l_partkey").alias("at"), (F.col("k") * 10).alias("place"))
    sections = r.select("l_orderkey", F.col("l_partkey").alias("section"), (F.col("k") * 8).alias("begin"), (F.col("k") * 8 + 8).alias("end"))
    return relational.containing(points, sections, "l_orderkey", "place", "begin", "end", 8).select("l_orderkey", "at", "section")


@query("""SELECT c_mktsegment, n_name, count(*) AS customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def joined_messages(spark, sf_dir):
    """Decoded fields are ordinary columns: join and group by them."""
    s = schema({"C": seq(field("key", "uint32"), field("nation", "uint8"), field("cents", "int64"), text("segment", "null_terminated", "ascii"))}, little=True)
    v = F.struct(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"), F.col("c_mktsegment").alias("segment"))
    m = round_trip(table(spark, sf_dir, "customer"), s, "C", v)
    n = table(spark, sf_dir, "nation")
    return m.select("m.*").join(n, F.col("nation") == F.col("n_nationkey")).groupBy(F.col("segment").alias("c_mktsegment"), "n_name").agg(F.count("*").alias("customers"), F.sum("cents").alias("cents"))


from . import formats, relations, streams  # noqa: E402, F401  they register their queries here
