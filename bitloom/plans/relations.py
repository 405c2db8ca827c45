"""Registered queries on what Spark adds to decoded messages: joins, windows, aggregates and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import codec, relational
from ..sources import files
from . import scratch
from .catalog import field, query, schema, seq, table, text

EVENT = schema({"Event": seq(field("event", "uint32"), field("user", "uint32"), field("micros", "int64"), field("value", "float64"), text("kind"))}, little=True)


def _events(spark, sf_dir) -> DataFrame:
    """Events as messages, decoded to columns."""
    e = table(spark, sf_dir, "events")
    v = F.struct(F.col("event_id").alias("event"), F.col("user_id").alias("user"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "value", F.col("event_type").alias("kind"))
    return codec.decode(codec.encode(e, v, EVENT, "Event", "wire").select("wire"), "wire", EVENT, "Event", "m").select("m.*")


@query("""SELECT a.event_id AS event, CAST(max(b.event_id) FILTER (WHERE b.ts = a.last) AS BIGINT) AS seen FROM
          (SELECT p.event_id, p.user_id, (SELECT max(v.ts) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts) AS last FROM events p WHERE p.event_type = 'purchase') a
          LEFT JOIN events b ON b.event_type = 'view' AND b.user_id = a.user_id AND b.ts = a.last GROUP BY a.event_id""")
def as_of_joins(spark, sf_dir):
    """Each purchase with the last view of its user before it."""
    e = _events(spark, sf_dir)
    views = e.where("kind = 'view'").select("user", "micros", F.col("event").alias("seen"))
    return relational.as_of(e.where("kind = 'purchase'").select("event", "user", "micros"), views, "user", "micros", "seen", ["seen"]).select("event", "seen")


@query("""SELECT 'semi' AS side, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
          UNION ALL SELECT 'anti', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def semi_and_anti_joins(spark, sf_dir):
    """Orders with and without a returned line, from decoded lines."""
    s = schema({"L": seq(field("key", "int64"), text("flag", "fixed", "ascii", length=1))})
    li = table(spark, sf_dir, "lineitem")
    lines = codec.decode(codec.encode(li, F.struct(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("flag")), s, "L", "wire").select("wire"), "wire", s, "L", "m")
    returned, o = lines.where("m.flag = 'R'").select(F.col("m.key").alias("o_orderkey")).distinct(), table(spark, sf_dir, "orders").select("o_orderkey")
    count = lambda how, name: o.join(returned, "o_orderkey", how).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return count("left_semi", "semi").union(count("left_anti", "anti"))


@query("""SELECT event_type AS kind, user_id % 3 AS third, count(*) AS n, grouping(event_type) * 2 + grouping(user_id % 3) AS level FROM events GROUP BY CUBE (event_type, user_id % 3)""")
def cubes(spark, sf_dir):
    e = _events(spark, sf_dir).select("kind", (F.col("user") % 3).alias("third"))
    return e.cube("kind", "third").agg(F.count("*").alias("n"), (F.grouping("kind").cast("long") * 2 + F.grouping("third")).alias("level"))


@query("""SELECT event_type AS kind, user_id % 3 AS third, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 3)""")
def rollups(spark, sf_dir):
    e = _events(spark, sf_dir).select("kind", (F.col("user") % 3).alias("third"))
    return e.rollup("kind", "third").agg(F.count("*").alias("n"))


@query("""SELECT event_id AS event, value FROM events ORDER BY value DESC, event_id LIMIT 20""")
def top_messages(spark, sf_dir):
    return _events(spark, sf_dir).orderBy(F.desc("value"), "event").limit(20).select("event", "value")


@query("""SELECT event_type AS kind, count(DISTINCT user_id) AS users, min(user_id) AS least FROM events GROUP BY 1""")
def distinct_users(spark, sf_dir):
    return _events(spark, sf_dir).select("kind", "user").distinct().groupBy("kind").agg(F.count("*").alias("users"), F.min("user").alias("least"))


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click')
          UNION ALL SELECT 'either', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE event_type = 'click')
          UNION ALL SELECT 'more views', CAST(sum(greatest(v - c, 0)) AS BIGINT) FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1)""")
def set_operations(spark, sf_dir):
    e = _events(spark, sf_dir)
    of = lambda kind: e.where(F.col("kind") == kind).select("user")
    views, clicks = of("view"), of("click")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(views.intersect(clicks), "both").union(count(views.union(clicks).distinct(), "either")).union(count(views.exceptAll(clicks), "more views"))


_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""SELECT l_orderkey, CAST(first(l_partkey ORDER BY {_LINE_ORDER}) AS BIGINT) AS first_part, CAST(last(l_partkey ORDER BY {_LINE_ORDER}) AS BIGINT) AS last_part FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def first_and_last(spark, sf_dir):
    """first<T> and last<T> as aggregates over records."""
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    returned = F.col("l_returnflag") == "R"
    first = relational.first_of(li, "l_orderkey", "k", "l_partkey", returned).withColumnRenamed("l_partkey", "first_part")
    last = relational.last_of(li, "l_orderkey", "k", "l_partkey", returned).withColumnRenamed("l_partkey", "last_part")
    return first.join(last, "l_orderkey")


@query("""SELECT c_custkey, CAST(o.o_orderkey AS BIGINT) AS pointer, o.o_orderstatus AS status FROM customer LEFT JOIN orders o ON o.o_custkey = c_custkey AND o.o_orderkey = c_custkey * 4""")
def dereferenced_pointers(spark, sf_dir):
    """Back references as a join on (message, offset)."""
    pointers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("message"), (F.col("c_custkey") * 4).alias("to"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("message"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"), F.lit(True).alias("found"))
    got = relational.dereferenced(pointers, targets, "message", "to", "at")
    return got.select(F.col("message").alias("c_custkey"), F.when(F.col("found"), F.col("to")).alias("pointer"), "status")


# Files --------------------------------------------------------------------------------------------

_RECORD = schema({"R": seq(text("key", "fixed", "ascii", length=9), text("segment", "fixed", "ascii", length=10), text("end", "fixed", "ascii", length=1, const="\n"))})


def _record_file(spark, sf_dir) -> str:
    """Customers as files of records of 20 bytes, each of which ends in a line feed."""
    c = table(spark, sf_dir, "customer")
    v = F.struct(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("key"), F.rpad("c_mktsegment", 10, " ").alias("segment"))
    out = scratch.path(spark, "records")
    w = codec.encode(c, v, _RECORD, "R", "wire")
    w.select(F.substring(F.col("wire").cast("string"), 1, 19).alias("line")).coalesce(2).write.text(out)
    return out


_RECORD_SQL = "SELECT c_custkey, c_mktsegment AS segment FROM customer"


@query(_RECORD_SQL)
def record_files(spark, sf_dir):
    """Files of fixed-size records, read by ranges through the engine's own data source."""
    files.register(spark)
    raw = spark.read.format("bitloom.records").option("recordLength", 20).option("recordsPerPartition", 4000).load(_record_file(spark, sf_dir))
    m = codec.decode(raw, "data", _RECORD, "R", "m", verify=True)
    return m.select(F.col("m.key").cast("long").alias("c_custkey"), F.rtrim("m.segment").alias("segment"))


@query(_RECORD_SQL)
def whole_files(spark, sf_dir):
    """The same from whole files, natively cut into records."""
    raw = files.records(files.read_binary(spark, _record_file(spark, sf_dir) + "/part-*"), 20)
    m = codec.decode(raw, "data", _RECORD, "R", "m", native=True)
    return m.select(F.col("m.key").cast("long").alias("c_custkey"), F.rtrim("m.segment").alias("segment"))


@query("""SELECT c_custkey, c_name AS name FROM customer""")
def stored_messages(spark, sf_dir):
    """The encode sink, and a schema file in JSON5, read back."""
    out = scratch.path(spark, "messages")
    text_ = "{types: {C: {sequence: [{name: 'key', type: 'uint32'}, // the customer\n {name: 'name', type: 'string', kind: 'length_prefixed', length_type: 'uint16', encoding: 'utf8'},]}}}"
    spark.createDataFrame([(text_,)], "value string").coalesce(1).write.text(f"{out}/schema")
    s = files.read_schema(spark, f"{out}/schema/part-*")
    rows = table(spark, sf_dir, "customer").select(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).alias("value"))
    files.write_messages(rows, "value", s, "C", f"{out}/messages")
    m = codec.decode(spark.read.parquet(f"{out}/messages"), "encoded", s, "C", "m")
    return m.select(F.col("m.key").alias("c_custkey"), "m.name")
