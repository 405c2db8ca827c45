"""Reply structure from quotations, in DataFrame functions only.

A message's lines are parsed into quote levels: leading ">" signs, with blanks between them, are
counted and stripped. What stands at level 0 is the message's own text; a line that ends in
"wrote:" or "schrieb:" before a quoted line is the quote's attribution and goes with it. At each level
the paragraphs and lines, in lower case and with white space made one blank, are hashed. The hashes
of quotes meet those of own texts within a conversation, where a hash belongs to the earliest message that has it,
its original; so a passage that very many messages repeat is one row before the join. A message
replies to the original that its shallowest linked level quotes most of, by characters, the latest on
a tie. Pointer jumping then finds each message's thread (root) and depth: sorted by conversation,
root and turn, messages stand in reply order, each after the one it answers.

Defined results: a null text has no lines and gives ""; a message that quotes nothing, or nothing that is
found in an earlier turn, is a root of depth 0; a null conv_id or turn never links; repeated rows
get the same links; the own text loses leading and trailing blank lines and nothing else but
quotes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?:wrote|schrieb):[ \t]*$"  # fixed values: how mail programs introduce a quote


def _lines(text: Column) -> Column:
    """level and content of each line."""
    split = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_substr(x, F.lit(MARKS)), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + "[ \t]?", "").alias("content")))
    return F.transform(split, lambda x: F.struct(F.coalesce(x["level"], F.lit(0)).alias("level"), x["content"].alias("content")))


def _own(lines: Column) -> Column:
    """Own text: level 0 without attributions."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["content"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["content"]), "\n"), r"\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\z", "")


def _units(text: Column) -> Column:
    """Normalised paragraphs and lines of a text, each once."""
    parts = F.concat(F.split(text, r"\n[ \t]*\n", -1), F.split(text, "\n", -1))
    return F.array_remove(F.array_distinct(F.transform(parts, lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))), "")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own text, and quoted: an array of (level, text), a level's lines with
    blank lines where another level stands between them."""

    def read(lines: Column) -> Column:
        levels = F.array_remove(F.array_distinct(F.transform(lines, lambda x: x["level"])), 0)
        at = lambda k: F.array_join(F.transform(lines, lambda x: F.when(x["level"] == k, x["content"]).otherwise("")), "\n")
        return F.struct(_own(lines).alias("text"), F.transform(levels, lambda k: F.struct(k.alias("level"), at(k).alias("text"))).alias("quoted"))

    # Lines are bound: else each use within a lambda would parse the whole text again.
    bound = F.element_at(F.transform(F.array(_lines(F.col("text"))), read), 1)
    return messages.select("conv_id", "turn", "role", bound.alias("x")).select("conv_id", "turn", "role", "x.text", "x.quoted")


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn for every message with a linked quote; messages as from parsed()."""
    quoted = messages.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", F.explode(_units(F.col("q.text"))).alias("unit"))
    quoted = quoted.select("conv_id", "turn", "level", F.md5(F.col("unit").cast("binary")).alias("hash"), F.length("unit").alias("weight"))
    wanted = quoted.select("conv_id", "hash").distinct()
    own = messages.where("turn is not null").select("conv_id", "turn", F.explode(_units(F.col("text"))).alias("unit")).select("conv_id", "turn", F.md5(F.col("unit").cast("binary")).alias("hash"))
    origins = own.join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    found = quoted.join(origins, ["conv_id", "hash"]).where("origin < turn").groupBy("conv_id", "turn", "level", "origin").agg(F.sum("weight").alias("weight"))
    best = F.max(F.struct((-F.col("level")).alias("level"), "weight", "origin"))
    return found.groupBy("conv_id", "turn").agg(best.alias("best")).select("conv_id", "turn", F.col("best.origin").alias("parent_turn"))


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn and depth, by pointer jumping: each round doubles the
    distance, so a chain of n replies takes log n rounds."""
    state = stored(parents.withColumn("root_turn", F.col("parent_turn")).withColumn("depth", F.lit(1).cast("long")), "threads")
    while not state.isEmpty():
        up = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        joined = state.join(up, ["conv_id", "root_turn"], "left")
        state = stored(joined.select("conv_id", "turn", "parent_turn", F.coalesce("higher", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "threads")
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("conv_id", "turn", "parent_turn", "root_turn", "depth")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, parent_turn, root_turn, depth, n_quotes."""
    read = stored(parsed(messages), "parsed")  # read by three jobs
    replies = threads(links(read))
    out = read.join(replies, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "text", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.size("quoted").cast("long").alias("n_quotes"))


def in_reply_order(threaded: DataFrame) -> DataFrame:
    return threaded.orderBy("conv_id", "root_turn", "turn")


_SQL_UNITS = "list_distinct([y FOR y IN [lower(trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) FOR x IN list_concat(regexp_split_to_array({0}, '\\n[ \\t]*\\n'), string_split({0}, chr(10)))] IF y <> ''])"
ORACLE_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS l FROM conversations),
p AS (SELECT rid, conv_id, turn, role, range(1, len(l) + 1) AS ix, [length(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) FOR x IN l] AS k, [regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') FOR x IN l] AS c FROM m),
o AS (SELECT *, regexp_replace(array_to_string([c[i] FOR i IN ix IF k[i] = 0 AND NOT (regexp_matches(c[i], '(?:wrote|schrieb):[ \t]*$') AND coalesce(k[i + 1], 0) > 0)], chr(10)), '\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\z', '', 'g') AS text, list_distinct([x FOR x IN k IF x > 0]) AS levels FROM p),
v AS (SELECT conv_id, turn, ix, k, c, unnest(levels) AS level FROM o),
t AS (SELECT conv_id, turn, level, array_to_string([CASE WHEN k[i] = level THEN c[i] ELSE '' END FOR i IN ix], chr(10)) AS text FROM v),
q AS (SELECT conv_id, turn, level, unnest({_SQL_UNITS.format("text")}) AS unit FROM t),
w AS (SELECT conv_id, turn, unnest({_SQL_UNITS.format("text")}) AS unit FROM o WHERE turn IS NOT NULL),
g AS (SELECT conv_id, unit, min(turn) AS origin FROM w GROUP BY ALL),
f AS (SELECT q.conv_id, q.turn, level, origin, sum(length(unit)) AS weight FROM q JOIN g USING (conv_id, unit) WHERE origin < turn GROUP BY ALL),
b AS (SELECT conv_id, turn, origin AS parent_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, weight DESC, origin DESC) AS r FROM f) WHERE r = 1),
u AS (SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM b UNION ALL SELECT u.conv_id, u.turn, b.parent_turn, u.depth + 1 FROM u JOIN b ON u.conv_id = b.conv_id AND u.root_turn = b.turn),
z AS (SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM u GROUP BY ALL)
SELECT o.conv_id, o.turn, role, text, parent_turn, coalesce(z.root_turn, o.turn) AS root_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth, CAST(len(levels) AS BIGINT) AS n_quotes
FROM o LEFT JOIN b USING (conv_id, turn) LEFT JOIN z USING (conv_id, turn)
"""
