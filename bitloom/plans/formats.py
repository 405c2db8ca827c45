"""Registered queries over whole formats, layouts and errors; each with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec
from .catalog import array, field, query, schema, seq, table, text

U8, U16, U32 = "uint8", "uint16", "uint32"

# Formats ------------------------------------------------------------------------------------------

# RFC 1035, 4.1. The order and widths of the fields, 0xC0 as the mark of a pointer.
_HOST = {
    "Octets": {"type": "string", "kind": "length_prefixed", "length_type": U8, "encoding": "ascii"},
    "Rest": {"type": "array", "kind": "null_terminated", "items": {"type": "Octets"}},
    "Suffix": {"type": "back_reference", "storage": U16, "offset_mask": "0x3FFF", "offset_from": "message_start", "target_type": "Rest"},
    "Part": {
        "type": "discriminated_union",
        "discriminator": {"peek": U8},
        "variants": [{"when": "value >= 0xC0", "type": "Suffix"}, {"when": "value < 64", "type": "Octets"}],
    },
    "Host": {"type": "array", "kind": "null_terminated", "items": {"type": "Part"}, "terminal_variants": ["Suffix"]},
}
_FLAGS = (("qr", 1), ("opcode", 4), ("aa", 1), ("tc", 1), ("rd", 1), ("ra", 1), ("z", 3), ("rcode", 4))
_HEADER = [
    field("id", U16),
    *[field(n, "bit", size=k) for n, k in _FLAGS],
    *[field(n, U16) for n in ("qdcount", "ancount", "nscount", "arcount")],
]


def _dns(name: str, *answer: dict) -> dict:
    record = seq(*answer, field("type", U16), field("class", U16), field("ttl", U32), field("rdlength", U16), field("rdata", "bytes", kind="field_referenced", length_field="rdlength"))
    return {
        **_HOST,
        "Question": seq(field("qname", name), field("qtype", U16), field("qclass", U16)),
        "Record": record,
        "Message": seq(
            *_HEADER,
            array("questions", "Question", "field_referenced", length_field="qdcount"),
            array("answers", "Record", "field_referenced", length_field="ancount"),
        ),
    }


@query("""SELECT o_orderkey, 'c' || o_custkey || '.' || lower(o_orderstatus) || '.test' AS host,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'w.c' || o_custkey || '.' || lower(o_orderstatus) || '.test' END AS answer,
          CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 86400 END AS BIGINT) AS ttl,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE upper(lpad(to_hex(o_custkey), 8, '0')) END AS address,
          CAST(CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 0 END AS BIGINT) AS rcode, CAST(o_orderkey % 65536 AS BIGINT) AS id FROM orders""")
def dns_messages(spark, sf_dir):
    """Replies with header bits, a question, and an answer whose name ends in a pointer to it."""
    m = codec.decode(dns_replies(spark, sf_dir), "wire", DNS, "Message", "m")
    host = lambda parts: F.array_join(F.transform(parts, lambda p: F.coalesce(p["Octets"], F.array_join(p["Suffix"], "."))), ".")
    a = F.get("m.answers", F.lit(0))
    return m.select(
        "o_orderkey", host(F.get("m.questions", F.lit(0))["qname"]).alias("host"), F.when(a.isNotNull(), host(a["name"])).alias("answer"),
        a["ttl"].alias("ttl"), F.hex(a["rdata"]).alias("address"), "m.rcode", F.col("m.id").cast("long").alias("id"),
    )


def dns_replies(spark, sf_dir):
    """o_orderkey and wire."""
    sent = schema(_dns("Rest", field("octets", "Octets"), field("to", U16, const=0xC00C)))  # the question's name is at byte 12
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    none, zero = k % 3 == 0, F.lit(0)
    flags = {"qr": F.lit(1), "rd": F.lit(1), "ra": F.lit(1), "rcode": F.when(none, 3).otherwise(0)}
    question = F.struct(F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lower("o_orderstatus"), F.lit("test")).alias("qname"), F.lit(1).alias("qtype"), F.lit(1).alias("qclass"))
    address = F.unhex(F.lpad(F.hex("o_custkey"), 8, "0"))
    record = F.struct(F.lit("w").alias("octets"), F.lit(1).alias("type"), F.lit(1).alias("class"), (k % 86400).alias("ttl"), F.lit(4).alias("rdlength"), address.alias("rdata"))
    v = F.struct(
        (k % 65536).alias("id"),
        *[flags.get(n, zero).alias(n) for n, _ in _FLAGS],
        F.lit(1).alias("qdcount"), F.when(none, 0).otherwise(1).alias("ancount"), zero.alias("nscount"), zero.alias("arcount"),
        F.array(question).alias("questions"), F.when(none, F.array().cast("array<" + o.select(record.alias("r")).schema["r"].dataType.simpleString() + ">")).otherwise(F.array(record)).alias("answers"),
    )
    return codec.encode(o, v, sent, "Message", "wire").select("o_orderkey", "wire")


DNS = schema(_dns("Host", field("name", "Host")))


# The ZIP application note, 4.3. The three signatures and the order of the fields.
_LOCAL, _CENTRAL, _END = 0x04034B50, 0x02014B50, 0x06054B50


@query("""SELECT c_custkey, c_name AS name, CAST(strlen(c_mktsegment) AS BIGINT) AS size, c_mktsegment AS body, CAST(0 AS BIGINT) AS local_at,
          CAST(30 + strlen(c_name) + strlen(c_mktsegment) AS BIGINT) AS central_at, CAST(46 + strlen(c_name) AS BIGINT) AS central_size, TRUE AS same_crc FROM customer""")
def zip_archives(spark, sf_dir):
    """An archive of one stored file per customer: local header, central directory, end record."""
    of = lambda kind, target, **more: {"computed": {"type": kind, "target": target, **more}}
    local, central = "../sections[corresponding<Local>]", "../sections[first<Central>]"
    s = schema({
        "Local": seq(field("signature", U32, const=_LOCAL), field("version", U16), field("flags", U16), field("method", U16), field("time", U16), field("date", U16), field("crc", U32, **of("crc32_of", "body")),
                     field("packed", U32, **of("length_of", "body")), field("size", U32, **of("length_of", "body")), field("name_size", U16, **of("length_of", "name", encoding="utf8")), field("extra_size", U16),
                     text("name", "field_referenced", length_field="name_size"), field("body", "bytes", kind="field_referenced", length_field="packed")),
        "Central": seq(field("signature", U32, const=_CENTRAL), field("made_by", U16), field("version", U16), field("flags", U16), field("method", U16), field("time", U16), field("date", U16), field("crc", U32, **of("crc32_of", f"{local}.body")),
                       field("packed", U32, **of("length_of", f"{local}.body")), field("size", U32, **of("length_of", f"{local}.body")), field("name_size", U16, **of("length_of", "name", encoding="utf8")), field("extra_size", U16), field("comment_size", U16),
                       field("disk", U16), field("internal", U16), field("external", U32), field("local_at", U32, **of("position_of", local)), text("name", "field_referenced", length_field="name_size")),
        "End": seq(field("signature", U32, const=_END), field("disk", U16), field("central_disk", U16), field("here", U16), field("entries", U16), field("central_size", U32, computed={"type": "sum_of_type_sizes", "target": "../sections", "element_type": "Central"}),
                   field("central_at", U32, **of("position_of", central)), field("comment_size", U16)),
        "Archive": seq(array("sections", {"type": "choice", "choices": [{"type": "Local"}, {"type": "Central"}, {"type": "End"}]}, "fixed", length=3)),
    }, little=True)
    zeros = lambda *names: [F.lit(0).alias(n) for n in names]
    one = F.struct(F.lit(20).alias("version"), *zeros("flags", "method", "time", "date", "extra_size"), F.col("c_name").alias("name"), F.col("c_mktsegment").cast("binary").alias("body")).alias("Local")
    two = F.struct(F.lit(20).alias("made_by"), F.lit(20).alias("version"), *zeros("flags", "method", "time", "date", "extra_size", "comment_size", "disk", "internal", "external"), F.col("c_name").alias("name")).alias("Central")
    end = F.struct(*zeros("disk", "central_disk"), F.lit(1).alias("here"), F.lit(1).alias("entries"), F.lit(0).alias("comment_size")).alias("End")
    v = F.struct(F.array(*[F.struct(F.lit(n).alias("type"), one, two, end) for n in ("Local", "Central", "End")]).alias("sections"))
    w = codec.encode(table(spark, sf_dir, "customer"), v, s, "Archive", "wire").select("c_custkey", "wire")
    m = codec.decode(w, "wire", s, "Archive", "m", verify=True)
    part = lambda k, n: F.get("m.sections", F.lit(k))[n]
    one, two, end = part(0, "Local"), part(1, "Central"), part(2, "End")
    return m.select(
        "c_custkey", two["name"].alias("name"), two["size"].alias("size"), one["body"].cast("string").alias("body"), two["local_at"].alias("local_at"),
        end["central_at"].alias("central_at"), end["central_size"].alias("central_size"), ((one["crc"] == two["crc"]) & (one["crc"] == F.crc32(one["body"]))).alias("same_crc"),
    )


# Layouts ------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CAST(5 AS BIGINT) AS name_at, CAST(6 + strlen(c_mktsegment) AS BIGINT) AS inner_size, CAST(9 + strlen(c_mktsegment) AS BIGINT) AS more,
          CAST(10 + strlen(c_name) + strlen(c_mktsegment) AS BIGINT) AS both_size, CAST(c_custkey % 4 AS BIGINT) AS n FROM customer""")
def computed_layouts(spark, sf_dir):
    """position_of a field, length_of a struct, with an offset, sum_of_sizes and count_of."""
    of = lambda kind, target, **more: {"computed": {"type": kind, "target": target, **more}}
    s = schema({
        "Inner": seq(field("key", U16), text("segment")),
        "Outer": seq(field("mark", U8), field("name_at", U16, **of("position_of", "name")), field("n", U16, **of("count_of", "items")), text("name"), field("inner", "Inner"), field("inner_size", U16, **of("length_of", "inner")),
                     field("more", U16, **of("length_of", "inner", offset=3)), field("both_size", U16, computed={"type": "sum_of_sizes", "targets": ["name", "inner"]}), array("items", U8, "field_referenced", length_field="n")),
    })
    items = F.slice(F.array(*[F.lit(k) for k in range(3)]), 1, (F.col("c_custkey") % 4).cast("int"))
    v = F.struct(F.lit(1).alias("mark"), F.col("c_name").alias("name"), F.struct((F.col("c_custkey") % 65536).alias("key"), F.col("c_mktsegment").alias("segment")).alias("inner"), items.alias("items"))
    m = codec.decode(codec.encode(table(spark, sf_dir, "customer"), v, s, "Outer", "wire").select("c_custkey", "wire"), "wire", s, "Outer", "m")
    return m.select("c_custkey", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("name_at", "inner_size", "more", "both_size")], F.size("m.items").cast("long").alias("n"))


@query("""SELECT c_custkey, CAST(2 AS BIGINT) AS first_at, CAST(2 + 3 + strlen(c_name) + 3 AS BIGINT) AS second_at, CAST(strlen(c_mktsegment) AS BIGINT) AS last_size, TRUE AS same FROM customer""")
def corresponding_entries(spark, sf_dir):
    """Pointers and checksums of the n-th record of a type, for the n-th pointer of the same list."""
    s = schema({
        "Note": seq(field("mark", U16, const=0x4E4F), field("size", U8, computed={"type": "length_of", "target": "body"}), field("body", "bytes", kind="field_referenced", length_field="size")),
        "Ref": seq(field("mark", U16, const=0x5245), field("at", U8, computed={"type": "position_of", "target": "../entries[corresponding<Note>]"})),
        "Sum": seq(field("crc", U32, computed={"type": "crc32_of", "target": "../entries[last<Note>].body"}), field("size", U8, computed={"type": "length_of", "target": "../entries[last<Note>].body"})),
        "Book": seq(field("entries", "array", kind="length_prefixed", length_type=U16, items={"type": "choice", "choices": [{"type": "Note"}, {"type": "Ref"}]}), field("sum", "Sum")),
    })
    entry = lambda kind, body=None: F.struct(F.lit(kind).alias("type"), F.struct((F.lit(None).cast("binary") if body is None else F.col(body).cast("binary")).alias("body")).alias("Note"), F.struct(F.lit(None).cast("int").alias("at")).alias("Ref"))
    v = F.struct(F.array(entry("Note", "c_name"), entry("Ref"), entry("Note", "c_mktsegment"), entry("Ref")).alias("entries"), F.struct(F.lit(None).cast("int").alias("crc")).alias("sum"))
    m = codec.decode(codec.encode(table(spark, sf_dir, "customer"), v, s, "Book", "wire").select("c_custkey", "wire"), "wire", s, "Book", "m")
    at = lambda k: F.get("m.entries", F.lit(k))
    return m.select("c_custkey", at(1)["Ref"]["at"].cast("long").alias("first_at"), at(3)["Ref"]["at"].cast("long").alias("second_at"), F.col("m.sum.size").cast("long").alias("last_size"), (F.col("m.sum.crc") == F.crc32(at(2)["Note"]["body"])).alias("same"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(user_id AS BIGINT) END AS who, CASE WHEN event_type <> 'click' THEN event_type END AS what, CAST(event_id % 256 AS BIGINT) AS low FROM events""")
def inline_unions(spark, sf_dir):
    """A union at a position, told apart by a field; its list is as long as a field of the root says."""
    s = schema({
        "Who": seq(field("user", U32)), "What": seq(array("letters", U8, "field_referenced", length_field="_root.size")),
        "File": seq(field("at", U16), field("kind", U8), field("size", U8), instances=[{"name": "body", "type": {"discriminator": {"field": "kind"}, "variants": [{"when": "value == 1", "type": "Who"}, {"type": "What"}]}, "position": "at"}, {"name": "foot", "type": U8, "position": -1}]),
    })
    e, click = table(spark, sf_dir, "events"), F.col("event_type") == "click"
    size = F.octet_length("event_type")
    head = F.concat(F.unhex(F.lit("0006")), F.when(click, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("02"))), F.unhex(F.lpad(F.hex(size), 2, "0")), F.unhex(F.lit("EEEE")))
    body = F.when(click, F.unhex(F.lpad(F.hex("user_id"), 8, "0"))).otherwise(F.col("event_type").cast("binary"))
    w = e.select("event_id", F.concat(head, body, F.unhex(F.lpad(F.hex(F.col("event_id") % 256), 2, "0"))).alias("wire"))
    m = codec.decode(w, "wire", s, "File", "m")
    letters = F.array_join(F.transform("m.body.What.letters", lambda x: F.char(x)), "")
    return m.select("event_id", F.col("m.body.Who.user").alias("who"), F.when(F.col("m.body.type") == "What", letters).alias("what"), F.col("m.foot").cast("long").alias("low"))


@query("""SELECT n_nationkey, n_name AS word, n_name AS again FROM nation""")
def relative_pointers(spark, sf_dir):
    """Pointers that count from their own place."""
    s = schema({
        "Word": {"type": "string", "kind": "length_prefixed", "length_type": U8, "encoding": "ascii"},
        "Ahead": {"type": "back_reference", "storage": U16, "offset_mask": "0x00FF", "offset_from": "current_position", "target_type": "Word"},
        "Pair": seq(field("first", "Ahead"), field("second", "Ahead"), field("word", "Word")),
    })
    n = table(spark, sf_dir, "nation")
    w = n.select("n_nationkey", F.concat(F.unhex(F.lit("00040002")), F.unhex(F.lpad(F.hex(F.octet_length("n_name")), 2, "0")), F.col("n_name").cast("binary")).alias("wire"))
    m = codec.decode(w, "wire", s, "Pair", "m").where("m.first = m.word")
    return m.select("n_nationkey", F.col("m.first").alias("word"), F.col("m.second").alias("again"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 16 AS BIGINT) AS high, CAST(o_custkey % 256 AS BIGINT) AS mid, CAST(o_custkey % 16 AS BIGINT) AS low, 'ORD' AS mark,
          CASE WHEN o_orderkey % 2 = 0 THEN 'Even' ELSE 'Odd' END AS kind, CAST(o_custkey AS BIGINT) AS key FROM orders""")
def odd_places(spark, sf_dir):
    """A byte off a byte boundary, a constant text, and a choice by a big-endian tag of two bytes."""
    s = schema({
        "Even": seq(field("tag", U16, const=0x0102), field("key", U32)), "Odd": seq(field("tag", U16, const=0x0201), field("pad", U8), field("key", U32)),
        "M": seq(field("high", "bit", size=4), field("mid", U8), field("low", "bit", size=4), text("mark", "fixed", "ascii", length=3, const="ORD"), field("body", "choice", choices=[{"type": "Even"}, {"type": "Odd"}])),
    })
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    even = F.struct(F.when(k % 2 == 0, "Even").otherwise("Odd").alias("type"), F.struct(c.alias("key")).alias("Even"), F.struct(F.lit(0).alias("pad"), c.alias("key")).alias("Odd"))
    v = F.struct((k % 16).alias("high"), (c % 256).alias("mid"), (c % 16).alias("low"), even.alias("body"))
    m = codec.decode(codec.encode(o, v, s, "M", "wire").select("o_orderkey", "wire"), "wire", s, "M", "m", verify=True)
    return m.select("o_orderkey", "m.high", F.col("m.mid").cast("long").alias("mid"), "m.low", "m.mark", F.col("m.body.type").alias("kind"), F.coalesce("m.body.Even.key", "m.body.Odd.key").alias("key"))


@query("""SELECT c_custkey, c_name AS wide, c_mktsegment AS ended, CAST(c_custkey % 5 AS BIGINT) AS n, CAST(c_custkey % 3 AS BIGINT) AS whole FROM customer""")
def wide_texts(spark, sf_dir):
    """UTF-16 of either byte order, lists of lists, and a last item that is cut off."""
    s = schema({"T": seq(text("wide", encoding="utf16"), text("ended", "null_terminated", "utf16"), array("grid", {"type": "array", "kind": "length_prefixed", "length_type": U8, "items": {"type": U16}}), array("rest", U32, "eof_terminated"))})
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    grid = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.array_repeat(i, (i % 3).cast("int")))
    v = F.struct(F.col("c_name").alias("wide"), F.col("c_mktsegment").alias("ended"), F.slice(grid, 1, (k % 5).cast("int")).alias("grid"), F.array_repeat(F.lit(7), (k % 3).cast("int")).alias("rest"))
    w = codec.encode(c, v, s, "T", "wire").select("c_custkey", F.concat("wire", F.unhex(F.lit("0102"))).alias("wire"))
    m = codec.decode(w, "wire", s, "T", "m")
    return m.select("c_custkey", "m.wide", "m.ended", F.size("m.grid").cast("long").alias("n"), F.size("m.rest").cast("long").alias("whole"))


@query("""SELECT event_id, props, CAST(strlen(props) AS BIGINT) AS size FROM events""")
def single_messages(spark, sf_dir):
    """A protocol of one message without a tag, whose payload's length is a field of the header."""
    s = schema({"Head": seq(field("size", U16), field("event", U32)), "Note": seq(text("props", "field_referenced", length_field="size"))}, protocol={"name": "notes", "version": "1", "header": "Head", "messages": [{"code": 1, "name": "NOTE", "payload_type": "Note"}]})
    e = table(spark, sf_dir, "events")
    v = F.struct(F.octet_length("props").alias("size"), F.col("event_id").alias("event"), F.struct("props").alias("payload"))
    m = codec.decode(codec.encode(e, v, s, "Frame", "wire").select("wire"), "wire", s, "Frame", "m")
    return m.select(F.col("m.event").alias("event_id"), "m.payload.props", F.col("m.size").cast("long").alias("size"))


@query("""SELECT o_orderkey, CAST((o_custkey % 7 - 3) AS BIGINT) AS n FROM orders WHERE o_custkey % 7 >= 3""")
def derived_counts(spark, sf_dir):
    """A list as long as an expression over earlier fields says; where that is negative, an error."""
    s = schema({"C": seq(field("a", U8), field("b", U8), array("items", U8, "computed_count", count_expr="(a * 2 - 6) / b"))})
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey") % 7
    w = o.select("o_orderkey", F.concat(F.unhex(F.lpad(F.hex(k), 2, "0")), F.unhex(F.lit("02")), F.unhex(F.repeat(F.lit("05"), 4))).alias("wire"))
    m = codec.decode(w, "wire", s, "C", "m", mode=codec.PERMISSIVE)
    return m.where("m_error is null").select("o_orderkey", F.size("m.items").cast("long").alias("n"))


@query("""SELECT CASE o_orderkey % 6 WHEN 0 THEN 'INVALID_VARIANT' WHEN 1 THEN 'CIRCULAR_REFERENCE' WHEN 2 THEN 'OUT_OF_BOUNDS' WHEN 3 THEN 'INVALID_UTF8' WHEN 4 THEN 'INVALID_VALUE' ELSE 'INCOMPLETE_DATA' END AS code,
          count(*) AS n FROM orders GROUP BY 1""")
def error_kinds(spark, sf_dir):
    """Messages that are wrong in six ways, told apart by their error; none stops the job."""
    s = schema({
        "Loop": {"type": "back_reference", "storage": U16, "offset_mask": "0x00FF", "offset_from": "message_start", "target_type": "Body"}, "Text": seq(text("t", "fixed", length=1)), "Far": seq(field("at", U8), instances=[{"name": "x", "type": U8, "position": "at"}]),
        "Ratio": seq(field("by", U8), array("n", U8, "computed_count", count_expr="1 / by")), "Long": seq(field("x", "uint64")),
        "Body": {"type": "discriminated_union", "discriminator": {"peek": U8}, "variants": [{"when": "value == 0x80", "type": "Loop"}, {"when": "value == 2", "type": "Far2"}, {"when": "value == 0xFF", "type": "Text"}, {"when": "value == 0", "type": "Ratio"}, {"when": "value == 5", "type": "Long"}]},
        "Far2": seq(field("tag", U8), field("far", "Far")), "M": seq(field("body", "Body")),
    })
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "07").when(k == 1, "8000").when(k == 2, "02FF").when(k == 3, "FF").when(k == 4, "00").otherwise("0501")
    m = codec.decode(table(spark, sf_dir, "orders").select(F.unhex(raw).alias("wire")), "wire", s, "M", "m", mode=codec.PERMISSIVE, strict=True)
    return m.groupBy(F.col("m_error.code").alias("code")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS units, CAST(4 + strlen(c_name) + 4 AS BIGINT) AS size FROM customer""")
def sql_functions(spark, sf_dir):
    """A decoder and a table function as SQL has them."""
    s = schema({"R": seq(text("name"), array("tail", U16))})
    codec.register(spark, "bitloom_r", s, "R")
    codec.register_items(spark, "bitloom_r_items", s, "R", "tail")
    w = codec.encode(table(spark, sf_dir, "customer"), F.struct(F.col("c_name").alias("name"), F.array(F.lit(7)).alias("tail")), s, "R", "wire").select("c_custkey", "wire")
    w.createOrReplaceTempView("bitloom_messages")
    return spark.sql("""SELECT c_custkey, CAST(length(bitloom_r(wire).value.name) AS BIGINT) AS units, CAST(octet_length(wire) AS BIGINT) AS size
                        FROM bitloom_messages, LATERAL bitloom_r_items(wire) AS i WHERE i.item = 7 AND i.index = 0""")


_CRC_TABLE = """RECURSIVE bit(b, k, v) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
  crc_table AS (SELECT list(v ORDER BY b) AS t FROM bit WHERE k = 8)"""


@query(f"""WITH {_CRC_TABLE}
          SELECT c_custkey, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::BIGINT)), lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1])), 4294967295) AS BIGINT) AS crc, TRUE AS same FROM customer, crc_table""")
def checksums(spark, sf_dir):
    """CRC-32 written by the encoder and checked by a verifying decode; SQL derives its table bit by bit."""
    s = schema({"C": seq(field("n", U16, computed={"type": "length_of", "target": "data"}), field("data", "bytes", kind="field_referenced", length_field="n"), field("crc", U32, computed={"type": "crc32_of", "target": "data"}))})
    w = codec.encode(table(spark, sf_dir, "customer"), F.struct(F.col("c_name").cast("binary").alias("data")), s, "C", "wire").select("c_custkey", "wire")
    m = codec.decode(w, "wire", s, "C", "m", verify=True)
    return m.select("c_custkey", "m.crc", (F.col("m.crc") == F.crc32("m.data")).alias("same"))


@query("""SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS customer, CAST(octet_length(encode(o_orderpriority)) AS BIGINT) AS size FROM orders WHERE o_orderkey % 2 = 0""")
def native_fields(spark, sf_dir):
    """Column expressions only: encoded, stored columns read by fixed places, no Python anywhere."""
    s = schema({"N": seq(field("key", "int64"), field("customer", U32), text("priority"))})
    o = table(spark, sf_dir, "orders")
    w = codec.encode(o, F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority")), s, "N", "wire", native=True).select("wire")
    m = codec.decode(w, "wire", s, "N", "m", native=True).where("m.key % 2 = 0")
    return m.select(F.col("m.key").alias("o_orderkey"), F.col("m.customer").alias("customer"), F.octet_length("m.priority").cast("long").alias("size"))

