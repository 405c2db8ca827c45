import collections
import math
import random
import re

from bitloom.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    win = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def texts():
    rnd = random.Random(5)
    out = [None, "", " \t\n", "one", "a b c d e a b c d e", "x\n\n \nx\r\nx\n", "a b c d e f " * 4, "née 😀 %%% <b>| x y \x0b\x0c z", "tie " * 4000]
    for _ in range(60):
        out.append("".join(rnd.choice(["a", "b", "c ", " ", "\n", "#", "dé ", "e\t"]) for _ in range(rnd.randint(0, 200))))
    return out


def test_measures(spark):
    rows = [(i, t, "en", 1, "m") for i, t in enumerate(texts())] + [(None, "a b", None, 2, "m"), (1, "", "en", 1, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum int, m string")
    got = collections.Counter(tuple(r) for r in q.measured(df).select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = collections.Counter()
    for i, t, lang, *_ in rows:
        m = brute(t)
        want[(i, lang or "", *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert got == want


def test_binomial_tail(spark):
    cases = [(10, 0, 0.2), (50, 3, 0.2), (400, 20, 0.1), (2000, 100, 0.06), (5, 2, 0.1)]
    for n, k, p in cases:
        df = spark.createDataFrame([(n, k)], "n long, k long")
        got = df.select(q._tail(df.n, df.k, p)).first()[0]
        assert abs(got - (tail(n, k, p) if k < n * p else 1)) < 1e-9


def labelled(spark, n=3000):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    docs, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        docs.append((i, " ".join(word() + ("" if good else "%%%") for _ in range(rnd.randint(20, 40))), rnd.choice(["en", "de"]), "s"))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_certified_cutoffs_reject_the_bad_and_keep_the_good(spark):
    docs, labels = labelled(spark)
    kept = {r["quality"]: r["n"] for r in q.judge(docs, labels).where("kept").join(labels, "doc_id").groupBy("quality").count().withColumnRenamed("count", "n").collect()}
    assert kept.get(0, 0) == 0 and kept[1] >= 0.96 * 2400
    out = q.keep(docs.withColumn("n_words", docs.doc_id), labels)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_words"] and out.count() == kept[1]


def brute_judge(docs, labels, alpha=q.ALPHA, delta=q.DELTA):
    rows = []
    for i, text, lang in docs:
        n, chars, symbols, dup, rep = brute(text)
        lines = len([x for x in (text or "").split("\n") if WORD.search(x)])
        score = {"symbols": (symbols, n), "repeats": (rep, n), "dup_lines": (dup, lines), "long_words": (chars, n), "short_words": (-chars, n)}
        rows.append((i, lang or "", n < 10 or 100 * rep > 20 * n, {r: a / b if b else None for r, (a, b) in score.items()}))
    truth = {}
    for i, quality in labels:
        if i is not None and quality is not None:
            truth[i] = min(quality, truth.get(i, quality))
    seen = [(s, sc, truth[i]) for i, s, failed, sc in rows if not failed and i in truth]
    strata = {s for s, _, _ in seen}
    rejects = lambda v, sc: any(sc[r] is not None and sc[r] > c for r, c in v.items())
    cuts = {}
    for s in strata:
        best = 0
        good, bad = ([sc for t, sc, y in seen if t == s and (y > 0) == g] for g in (True, False))
        for sequence in q.SEQUENCES:
            for v in q._vectors(sequence):
                k, b = sum(rejects(v, sc) for sc in good), sum(rejects(v, sc) for sc in bad)
                if not (k < len(good) * alpha and tail(len(good), k, alpha) <= delta / (len(strata) * len(q.SEQUENCES))):
                    break
                if b > best:
                    best, cuts[s] = b, v
    return sorted((i, not failed and not rejects(cuts.get(s, {}), sc)) for i, s, failed, sc in rows), cuts


def mixed(n):
    rnd = random.Random(n)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.75
        word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([3, 5, 6]) if good or rnd.random() < 0.5 else rnd.choice([2, 12])))
        text = " ".join(word() + ("" if good and rnd.random() < 0.98 else rnd.choice(["", "", "%%", "#"])) for _ in range(rnd.randint(5, 30)))
        docs.append((i, text + ("\nsame line\nsame line" if not good and rnd.random() < 0.4 else ""), rnd.choice(["en", "en", "en", "de", None])))
        labels.append((i if rnd.random() < 0.95 else None, rnd.choice([int(good), None]) if rnd.random() < 0.05 else int(good)))
    return docs, [*labels, *labels[:20], (labels[30][0], 0)]


def test_cutoffs_and_verdicts_match_brute_force(spark):
    for n in (60, 700, 2500):
        docs, labels = mixed(n)
        want, cuts = brute_judge(docs, labels)
        assert bool(cuts) == (n > 60)
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
        lb = spark.createDataFrame(labels, "doc_id long, quality int")
        assert sorted((r.doc_id, r.kept) for r in q.judge(df, lb).collect()) == want
        assert sorted(r.doc_id for r in q.keep(df, lb).collect()) == [i for i, kept in want if kept]


def test_few_labels_certify_nothing(spark):
    docs, labels = labelled(spark, 100)
    assert q.judge(docs, labels).where("kept").count() == 100
    assert q.judge(docs, labels.limit(0)).where("kept").count() == 100
    assert q.judge(docs.limit(0), labels).count() == 0


def test_many_labels_shuffle_measures_and_no_texts(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(2000)), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(25_000).selectExpr("id AS doc_id", "int(id % 5 != 0) AS quality")  # too many to be sent to the documents

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled()
        assert q.keep(docs, labels).count() == 300
        assert shuffled() - before < 1_000_000 < sum(len(t) for _, t, _ in rows) / 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
