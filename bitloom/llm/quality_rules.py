"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base measures are taken of every whole text. Each rule scores a document (a high score is bad) and
rejects it above a cutoff; a vector has a cutoff for some of the rules and rejects what any of them
rejects. Vectors come in fixed sequences from the mildest on: one for each rule alone, and one in
which all rules step on by turns. Labelled documents are the holdout, per stratum: a vector is
certified if an exact binomial test shows that it falsely rejects at most `alpha` of the stratum's
good documents. A sequence is tested in its order up to the first vector that fails (a fixed
sequence needs no correction); over sequences and strata `delta` is divided by their number. So with
probability 1 - delta, in every stratum the chosen vector falsely rejects at most `alpha` of the
good documents. Of the certified vectors the one that rejects most bad documents is taken, the
first on a tie. Sequences do not depend on the labels, which therefore all count as holdout. With
the defaults and four strata a vector that falsely rejects none is certified from about 150 good
labels on; a stratum with fewer gets no cutoff and keeps what passes the base rules.

Defined results: a null text has no words, so it fails the base rule; a null stratum is the stratum
""; labels with a null id or quality are ignored, and of repeated labels of a document the lowest
counts; repeated rows are each measured; an empty table gives an empty result; extra columns are
ignored. Windows of words are compared by 64-bit hash, within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

ALPHA, DELTA = 0.04, 0.05
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
WORD, BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
#: name -> (score, cutoffs from the mildest on)
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "repeats": ("n_repeat_words / n_words", [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "long_words": ("word_chars / n_words", [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5]),
    "short_words": ("- word_chars / n_words", [-1.5, -2.0, -2.5, -3.0, -3.25, -3.5, -3.75, -4.0, -4.2]),
}


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(keys: Column, width: int) -> Column:
    """Words that lie in a window whose key occurs twice or more."""
    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def starts(p: Column) -> Column:
        same = lambda x, j: F.get(p, j).getField("k") == x.getField("k")
        twice = F.filter(p, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x.getField("i")))

    def length(s: Column) -> Column:
        step = F.transform(s, lambda x, j: F.least(F.coalesce(F.get(s, j + 1) - x, F.lit(width)), F.lit(width)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda acc, x: acc + x)

    return _bind(_bind(placed, starts), length)


def measures(text: Column, width: int = WINDOW) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))

        def repeats(h: Column) -> Column:
            keys = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
            found = _bind(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(_covered(k, width)))
            return F.when(F.size(h) < width, F.lit(0).cast("long")).otherwise(found)

        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _bind(hashes, repeats).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    of_lines = _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    of_text = _bind(F.array_remove(F.split(text, BLANK, -1), ""), of_words)
    return F.struct(of_text.alias("w"), of_lines.alias("l"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))


def _flat(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, the measures and base_failed, for every row."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), measures(F.col(text_col)).alias("m"))
    return _flat(df, "doc_id", "stratum").withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _score(rule: str) -> Column:
    top, below = RULES[rule][0].split(" / ")
    return F.expr(top).cast("double") / F.nullif(F.col(below), F.lit(0))


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term; 1 where k is not below n * p."""
    zero = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, i: F.struct((a["t"] + F.log(F.greatest(n - i, F.lit(1)) * p / ((i + 1) * (1 - p)))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), zero, step, lambda a: a["s"])
    return F.when(k < n * p, total).otherwise(F.lit(1.0))


#: Steps (rule, index of the cutoff that it takes on) of each sequence of vectors.
SEQUENCES: list[list[tuple[str, int]]] = [
    [(r, k) for k in range(max(len(g) for _, g in RULES.values())) for r, (_, g) in RULES.items() if k < len(g)],
    *[[(r, k) for k in range(len(g))] for r, (_, g) in RULES.items()],
]


def _vectors(sequence: list[tuple[str, int]]) -> list[dict[str, float]]:
    """The cutoffs after each step."""
    out: list[dict[str, float]] = []
    for rule, k in sequence:
        out.append({**(out[-1] if out else {}), rule: RULES[rule][1][k]})
    return out


def _first(sequence: list[tuple[str, int]]) -> Column:
    """The step from which on a document is rejected; null if it never is."""

    def step(rule: str) -> Column:
        grid, score = F.array(*[F.lit(float(c)) for c in RULES[rule][1]]), _score(rule)
        passed = F.size(F.filter(grid, lambda c: F.coalesce(score <= c, F.lit(True))))
        return F.get(F.array(*[F.lit(sequence.index((rule, k))) for k in range(len(RULES[rule][1]))]), passed)

    steps = [step(rule) for rule in dict(sequence)]
    return F.least(*steps) if len(steps) > 1 else steps[0]


def _truth(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and one nullable cutoff per rule, certified on all labelled documents."""
    seen = features.where("not base_failed").join(_truth(labels), "doc_id")
    firsts = F.explode(F.array(*[F.struct(F.lit(k).alias("sequence"), _first(q).alias("first")) for k, q in enumerate(SEQUENCES)]))
    # Per stratum and sequence as many rows as steps.
    counts = seen.select("stratum", "quality", firsts.alias("x")).groupBy("stratum", "x.sequence", "x.first").agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad"))
    runs = stored(counts.groupBy("stratum", "sequence").agg(F.sum("good").alias("n"), F.collect_list(F.struct("first", "good", "bad")).alias("at")), "quality-counts")
    family = max(1, runs.select("stratum").distinct().count()) * len(SEQUENCES)
    upto = lambda j, c: F.aggregate(F.filter("at", lambda x: x["first"] <= j), F.lit(0).cast("long"), lambda a, x: a + x[c])
    last = F.get(F.array(*[F.lit(len(q) - 1) for q in SEQUENCES]), F.col("sequence"))
    counted = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(j.alias("step"), upto(j, "good").alias("k"), upto(j, "bad").alias("b")))
    tests = F.transform(counted, lambda x: F.struct(x["step"].alias("step"), x["b"].alias("b"), (_tail(F.col("n"), x["k"], alpha) <= delta / family).alias("ok")))
    start = F.struct(F.lit(None).cast("int").alias("step"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("on"))
    take = lambda a, x: a["on"] & x["ok"] & (x["b"] > a["b"])
    walk = F.aggregate(tests, start, lambda a, x: F.struct(F.when(take(a, x), x["step"]).otherwise(a["step"]).alias("step"), F.when(take(a, x), x["b"]).otherwise(a["b"]).alias("b"), (a["on"] & x["ok"]).alias("on")))
    best = runs.select("stratum", "sequence", walk.alias("w")).groupBy("stratum").agg(F.max_by(F.struct("sequence", "w.step"), F.struct("w.b", -F.col("sequence"))).alias("x"))

    def cut(rule: str) -> Column:
        table = [F.array(*[F.lit(v.get(rule)).cast("double") for v in _vectors(q)]) for q in SEQUENCES]
        return F.get(F.get(F.array(*table), F.col("x.sequence")), F.col("x.step")).alias(f"cut_{rule}")

    return best.select("stratum", *[cut(r) for r in RULES])


def _rejected() -> Column:
    out = F.lit(False)
    for rule in RULES:
        out = out | F.coalesce(_score(rule) > F.col(f"cut_{rule}"), F.lit(False))
    return out


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The measures, base_failed and kept of every row of docs."""
    features = stored(measured(docs), "quality-measures")
    cuts = small(stored(cutoffs(features, labels, alpha, delta), "quality-cutoffs"))
    kept = ~F.col("base_failed") & ~_rejected()
    return features.join(cuts, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "stratum")


def keep(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that judge() keeps, as they are. No text is shuffled: few labels are sent to
    the documents, which then are the only ones measured for the cutoffs; with more labels all are, and
    measures alone meet their labels. Verdicts are found where the texts lie."""
    ids = stored(_truth(labels).select("doc_id"), "labelled")
    few = small(ids)
    holdout = docs if few is ids else docs.join(few, "doc_id", "left_semi")
    features = stored(measured(holdout), "quality-measures")
    cuts = small(stored(cutoffs(features, labels, alpha, delta), "quality-cutoffs"))
    row = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), measures(F.col("text")).alias("m"))
    flat = _flat(row, "row", "stratum").withColumn("base_failed", base_failed())
    # One condition that can't be taken apart: else its first half is pushed down and measures twice.
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~_rejected())
    return flat.join(cuts, "stratum", "left").where(kept).select("row.*")


def oracle_sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """judge() over documents and labels, in DuckDB SQL."""
    scores = {r: e.replace(" / ", "::DOUBLE / nullif(") + ", 0)" for r, (e, _) in RULES.items()}
    passed = lambda r: f"len([c FOR c IN {[float(c) for c in RULES[r][1]]} IF coalesce(score_{r} <= c, true)])"
    first = lambda q: "least(" + ", ".join(f"{[q.index((r, k)) for k in range(len(RULES[r][1]))]}[{passed(r)} + 1]" for r in dict(q)) + ", NULL)"
    firsts = "[" + ", ".join(f"{{'s': {k}, 'first': {first(q)}}}" for k, q in enumerate(SEQUENCES)) + "]"
    cut = lambda r: f"{[[v.get(r) for v in _vectors(q)] for q in SEQUENCES]}[s + 1][step + 1] AS cut_{r}".replace("None", "NULL")
    rejected = " OR ".join(f"coalesce(score_{r} > cut_{r}, false)" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, range({WINDOW}) r(o) GROUP BY rid),
m AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {", ".join(f"{e} AS score_{r}" for r, e in scores.items())} FROM m),
truth AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
x AS (SELECT stratum, quality, unnest({firsts}) AS x FROM f JOIN truth USING (doc_id) WHERE NOT base_failed),
c AS (SELECT stratum, x.s AS s, step, count(*) FILTER (quality > 0) AS n, count(*) FILTER (quality > 0 AND x.first <= step) AS k, count(*) FILTER (quality <= 0 AND x.first <= step) AS b
      FROM x, range({max(len(q) for q in SEQUENCES)}) r(step) WHERE step < {[len(q) for q in SEQUENCES]}[x.s + 1] GROUP BY ALL),
p AS (SELECT *, CASE WHEN k < n * {alpha} THEN list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})) FOR i IN range(k + 1)]) ELSE 1 END <= {delta} / ((SELECT count(DISTINCT stratum) FROM x) * {len(SEQUENCES)}) AS ok FROM c),
v AS (SELECT stratum, s, step FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, s ORDER BY step) AS held FROM p) WHERE held AND b > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY b DESC, s, step) = 1),
cuts AS (SELECT stratum, {", ".join(cut(r) for r in RULES)} FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept, stratum FROM f LEFT JOIN cuts USING (stratum)
"""
