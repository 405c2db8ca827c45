import zlib

import numpy as np

from bitloom.llm import langid


def corpus():
    rng = np.random.default_rng(1)
    parts = {"aa": ["ing", "the", "tion", "er"], "bb": ["keit", "ung", "sch", "ein"], "cc": ["é", "eau", "tre", "qu"]}
    rows = []
    for i in range(360):
        lang = ("aa", "bb", "cc")[i % 3] if i % 7 else None
        words = ["".join(rng.choice(parts[lang or "aa"], 3)) for _ in range(rng.integers(3, 60))]
        rows.append((i, " ".join(words), lang, "s", 0.5))
    return rows + [(1000, None, "aa", "s", 0.1), (1001, " 12 -_ ", "bb", "s", 0.1), (1002, "", None, "s", 0.1), (None, "the ing", "aa", "s", 0.1), (1003, "keitung " * 40000, "bb", "s", 0.1)]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in langid.learn_and_identify(df).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    held = [(r[2], got[r[0]].lang_pred) for r in rows if r[2] and r[0] is not None and got[r[0]].held_out and r[0] < 1000]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert got[1003].lang_pred == "bb"
    assert langid.learn_and_identify(df.limit(0)).count() == 0


def test_prediction_uses_text_only(spark):
    model = langid.train([(a, t) for a, t in [("aa", "the ing tion"), ("bb", "keit ung sch")] * 30])
    df = spark.createDataFrame([(1, "the thing", "bb"), (2, "the thing", None)], "doc_id long, text string, lang string")
    assert len({(r.lang_pred, r.score) for r in langid.identify(df, model).collect()}) == 1


def test_sample_reads_all_over_a_text(spark):
    """A long text that opens in another language is learned by what it mostly is."""
    df = spark.createDataFrame([(i, "keit ung " * 40 + "the ing " * 2000, "aa") for i in range(4)], "doc_id long, text string, lang string")
    for lang, text in langid.sample(df):
        assert lang == "aa" and len(text) <= langid.SAMPLE_CHARS + 8 and text.count("ing") > 2 * text.count("ung")


def test_too_many_languages_are_an_error(spark):
    import pytest

    df = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    assert len(langid.sample(df, max_languages=5)) == 5
    with pytest.raises(ValueError, match="languages"):
        langid.sample(df, max_languages=4)


def test_accepted_answers_have_the_stated_precision():
    """On the calibration texts, some of which are mislabelled."""
    rng = np.random.default_rng(4)
    parts = {"aa": ["ing", "the", "tion"], "bb": ["keit", "ung", "sch"]}
    text = lambda k, n: " ".join("".join(rng.choice(parts[k], 3)) for _ in range(n))
    examples = [(k if i % 9 else "aabb".replace(k, ""), text(k, int(rng.integers(1, 30)))) for i in range(400) for k in ("aa", "bb")]
    model = langid.train([*examples, *examples[:200]])
    held = [*examples, *examples[:200]][-200:]
    got = [(model.predict(t), k) for k, t in held]
    accepted = [p[0] == k for p, k in got if p[2]]
    assert not accepted or sum(accepted) >= langid.PRECISION * len(accepted)


def test_gradient_step_lowers_the_loss():
    one = langid.train([("aa", "the ing tion the ing"), ("bb", "keit ung sch keit")] * 20)
    for k, t in (("aa", "the tion"), ("bb", "ung keit")):
        assert one.predict(t)[0] == k and one.predict(t)[1] > 0.6
