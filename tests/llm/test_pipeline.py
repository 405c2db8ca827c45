"""The pipeline against brute-force versions of its stages on a small corpus."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp  # noqa: E402

from bitloom.llm.common import stored  # noqa: E402

from .test_decontaminate import brute as contaminated  # noqa: E402
from .test_quality_rules import brute as measured  # noqa: E402
from .test_simhash import brute as components  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, out = random.Random(9), tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, item = text(90), text(30)
    docs = [(i, text(rnd.randint(40, 120)), "en", "s", 1) for i in range(40)]
    docs += [(50, docs[0][1], "en", "s", 1), (51, docs[3][1], None, "s", 1), (52, text(40) + " " + passage, "en", None, 1), (53, passage + " " + text(50), "en", "s", 1)]
    docs += [(54, text(30) + " " + item + " " + text(30), "de", "s", 1), (55, "too short", "en", "s", 1), (56, None, None, None, None), (57, "one two three four five " * 9, "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_each_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, columns = {}, docs.columns
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        docs = stored(stage(spark, docs, folder), "test")
        if name != "sentencepiece":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            m = {d: measured(t) for d, t in before.items()}
            assert set(after) == {d for d, x in m.items() if x[0] >= 10 and 100 * x[4] <= 20 * x[0]}
        elif name == "simhash_near_dedup":
            assert set(after) == {d for d, _, c in components(list(before.items())) if d == c} and 50 not in after
        elif name == "suffix_array_dedup":
            assert set(after) == set(before) and {d for d in after if after[d] != before[d]} == {52, 53}
        elif name == "decontamination":
            assert set(before) - set(after) == {r[0] for r in contaminated(list(before.items()), [(7, spark.read.parquet(f"{folder}/benchmark.parquet").first().text)]) if r[-1]} == {54}
        seen[name] = docs.count()
    assert docs.where("not round_trip").count() == 0
    assert cp.run(spark, folder).count() == seen["sentencepiece"] == seen["decontamination"]
