import collections
import re

import pytest

P = pytest.importorskip("public_tokenizers")

from bitloom.llm import token_rollup as t  # noqa: E402

ONE, TWO = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_multi_50k.tiktoken")
NAMES = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
ROWS = [(1, "a b c d e f g h i j k", "s", "en"), (2, "A, b-c! é😀\nA, b-c! é😀 1 2 3 4 5 6 7 8", None, "en"), (3, None, "s", None), (4, "", "s", "en"), (5, "x y\nx y\nx y\nx y\nx y", "s", "en"), (5, "x y\nx y\nx y\nx y\nx y", "s", "en"), (6, "same\nsame", "s", "en"), (None, "w " * 50000, None, None), (7, "<|endoftext|> " * 12, "s", "fr")]


def brute(rows):
    """Totals after each batch, each from the documents as they are then."""
    lines = lambda x: "\n".join(dict.fromkeys(x.split("\n")))
    short = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x)) < 10
    n = lambda path, x: len(t._vocabulary(path, P.PATTERN).encode_ordinary(x))
    out = []
    for batch, versions, cut, drop in (("1-load", 1, False, False), ("2-second-version", 2, False, False), ("3-revised", 2, True, False), ("4-deleted", 2, True, True)):
        sums = collections.defaultdict(lambda: [0, 0])
        for _, text, source, lang in rows:
            text = text or ""
            if drop and short(text):
                continue
            for k, path in list(enumerate((ONE, TWO)))[:versions]:
                x = sums[source, lang, NAMES[k]]
                x[0] += 1
                x[1] += n(path, lines(text) if cut and k == 0 else text)
        out += [(batch, *k, *v) for k, v in sums.items()]
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(*r, 1, 2, "v") for r in ROWS], "doc_id long, text string, source string, lang string, docs int, tokens int, v1 string")
    assert sorted(map(tuple, t.maintained(df, ONE, TWO, P.PATTERN).collect()), key=str) == brute(ROWS)
    assert t.maintained(df.limit(0), ONE, TWO, P.PATTERN).count() == 0


def test_batches_commit_once_and_compact(spark, tmp_path):
    r = t.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    kind = f"before {t.IMAGE}, after {t.IMAGE}"
    a = spark.createDataFrame([(None, ("s", "en", "t", 5)), (None, ("s", "en", "t", 7)), (None, None)], kind)
    other = spark.createDataFrame([(None, ("s", "en", "t", 6))], kind)
    assert r.commit("a", a) and not r.commit("a", a)
    with pytest.raises(ValueError, match="another delta"):
        r.commit("a", other)
    assert r.commit("b", spark.createDataFrame([(("s", "en", "t", 5), ("s", "en", "t", 6)), (("s", "en", "t", 7), None)], kind))
    assert r.commit("c", a.limit(0)) and r.batches() == ["batch=a", "batch=b", "batch=c"]
    want = [("s", "en", "t", 1, 6)]
    assert [tuple(x) for x in r.totals().collect()] == want
    for _ in range(2):
        r.compact()
        assert r.batches() == ["batch=a", "batch=b", "batch=c"] and not r._folders("batch=") and len(r._folders("base=")) == 1
        assert [tuple(x) for x in r.totals().collect()] == want
        assert not r.commit("a", a) and not r.commit("c", a.limit(0))
        with pytest.raises(ValueError, match="another delta"):
            r.commit("b", other)
    assert r.commit("d", other) and [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 2, 12)]
    r.compact()
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 2, 12)] and not r._folders("_aside")
