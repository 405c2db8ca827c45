import hashlib
import random
import re

from bitloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, size=13):
    wins = {}
    for i, t in items:
        w = WORD.findall(fold(t))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for doc, t in docs:
        w, hit, own = WORD.findall(fold(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    own |= wins[x]
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    rnd = random.Random(2)
    word = lambda: rnd.choice(["a", "b", "é", "x1", "Zed", "q😀"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 13, 14, 20, 40, 2, 1])] + [(7, ""), (8, None), (9, "a-b_É"), (1, "b b b")]
    docs = [(None, "a b"), (0, None), (1, ""), (2, "--"), (3, items[3][1]), (3, items[3][1])]
    for i in range(80):
        w = [word() for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            at = rnd.randint(0, len(w))
            w[at:at] = (rnd.choice(items)[1] or "").split()
        docs.append((100 + i, rnd.choice([" ", ", ", "\n"]).join(w)))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(a, b, 1, "t") for a, b in docs], "doc_id long, text string, n_words int, terms string"), spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark, monkeypatch):
    docs, items = data()
    items = [x for x in items if x[1] is not None or True]
    a, b = frames(spark, docs, items)
    want = brute(docs, items)
    for segment, block in ((8 << 20, d.PHRASES), (300, 5)):
        monkeypatch.setattr(d, "SEGMENT_BYTES", segment)
        assert sorted(map(tuple, d.contamination(a, b, block=block).collect()), key=str) == want


def test_phrase_and_proximity_search(spark):
    docs, _ = frames(spark, [(1, "the Quick brown fox"), (2, "fox the brown"), (3, "quick x x x x x x x x brown"), (4, "brown fox brown fox")], [])
    index = d.build_index(docs)
    phrases = spark.createDataFrame([(["brown", "fox"], ["i"]), (["quick", "brown"], ["j"])], "phrase array<string>, items array<string>")
    exact = {tuple(r) for r in d.search(index, phrases).collect()}
    assert exact == {(1, "i", 2, 2), (4, "i", 0, 2), (4, "i", 2, 2), (1, "j", 1, 2)}
    close = {(r.doc_id, r.item) for r in d.search(index, phrases, span=3, block=1).collect()}
    assert close == {(1, "i"), (2, "i"), (4, "i"), (1, "j")}


def test_empty_tables(spark):
    a, b = frames(spark, [(1, "x y")], [(1, "x y")])
    assert d.contamination(a.limit(0), b).count() == 0
    assert [r.n_hit for r in d.contamination(a, b.limit(0)).collect()] == [0]
