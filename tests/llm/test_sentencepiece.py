import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from bitloom.llm import sentencepiece_codec as c  # noqa: E402

PATH = P.path("piece_bpe_32k.model")


def texts():
    rnd = random.Random(1)
    out = ["", "  ", " a", "▁x ▁▁ y", "a  b   c", "<s> </s> <0x0A> <unk>", "日本語テキスト 😀 \x00 \n\t", "\n\n a\r\n", "trail   ", "x" * 3000, "ab " * 2000, "▁", "é" * 50, "the of and tion" * 400]
    return out + ["".join(rnd.choice("ab ▁é😀\n<0xA>the") for _ in range(rnd.randint(0, 60))) for _ in range(500)]


def test_encoder_and_decoder_match_the_library():
    codec, lib = c.Codec(PATH, 1), sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = list(codec.encode_batch(texts()))
    assert got == lib.encode(texts())
    assert [codec.model.encode(t) for t in texts()] == got
    assert [codec.model.decode(x) for x in got] == lib.decode(got)


def test_decoder_on_any_ids():
    model, lib, rnd = c.Model.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(3)
    for _ in range(3000):
        ids = [rnd.choice([3 + rnd.randrange(256), rnd.randrange(32000), 0, 1]) for _ in range(rnd.randint(0, 8))]
        assert model.decode(ids) == lib.decode(ids)


def test_query_in_arrow_batches(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(i, t) for i, t in enumerate([*texts(), None])] + [(0, "tie"), (0, "tie"), (None, "x")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_tokens int")
    want = []
    for i, t in rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert sorted(map(tuple, c.digests(df, PATH, 1).collect()), key=str) == sorted(want, key=str)
    full = c.encode_decode(df, PATH).collect()
    assert len(full) == len(rows) and all(r.n_tokens == len(r.ids) for r in full)
    assert c.digests(df.limit(0), PATH).count() == 0
