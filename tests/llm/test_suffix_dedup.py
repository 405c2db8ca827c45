import collections
import hashlib
import random

import pytest

from bitloom.llm import suffix_dedup as s


def brute(rows, length=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_cover_covers():
    for r in (1, 2, 3):
        v, d = s.cover(r)
        assert len(d) == 6 * r + 4 and {(a - b) % v for a in d for b in d} == set(range(v))


def corpus():
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passages = [text(n) for n in (200, 260, 370, 395, 420, 700, 1500)]
    rows = [(None, None), (1, ""), (2, "x" * 399), (3, "y" * 400), (4, "z" * 401), (5, "ab" * 900)]
    for i in range(60):
        parts = [text(rnd.randint(0, 300))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 30)
            parts += [p[a : len(p) - rnd.randint(0, 30)], text(rnd.randint(0, 200))]
        rows.append((10 + i, "".join(parts)))
    base = text(1200)
    for i in range(20):
        k = rnd.randrange(len(base))
        rows.append((100 + i, base[:k] + rnd.choice("XYZ") + base[k + 1 :]))
    return rows + [(200, base), (200, base), (201, passages[5][:399]), (202, passages[5][:400])]


@pytest.mark.parametrize("small", ["no", "blocks", "buckets", "hot"])
def test_matches_brute_force(spark, monkeypatch, small):
    rows = corpus()
    if small != "no":
        monkeypatch.setattr(s, "BLOCK_BYTES", 5000)
        monkeypatch.setattr(s, "TILE", 1000)
    if small == "buckets":
        monkeypatch.setattr(s, "BUCKET_BYTES", 1)
    if small == "hot":  # every anchor with two segments is grouped in Spark
        monkeypatch.setattr(s, "HOT_BYTES", 0)
    df = spark.createDataFrame([(i, t, 0, b"") for i, t in rows], "doc_id long, text string, block int, data binary")
    assert sorted(map(tuple, s.removed(df).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.removed(df).count() == 0


def test_keep_cuts_texts_and_carries_columns(spark):
    base = "".join(random.Random(4).choice("abcdefgh") for _ in range(500))
    rows = [(1, "head " + base, "en", 505), (2, base + " tail", None, 505), (3, "é" * 10, "de", 10), (4, None, "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, n_chars long")
    got = sorted(map(tuple, s.keep(df).collect()))
    assert got == [(1, "head ", "en", 5), (2, " tail", None, 5), (3, "é" * 10, "de", 10), (4, "", "de", None)]


def test_small_cover_covers():
    assert {(a - b) % s.SMALL_V for a in s.SMALL_D for b in s.SMALL_D} == set(range(s.SMALL_V))


@pytest.mark.parametrize("length", [60, 100, 400])
def test_sort_of_a_bucket(length):
    """Against the strings themselves: few letters, so that ties are long and strings overlap."""
    import numpy as np

    rnd = random.Random(length)
    for trial in range(12):
        unit = bytes(rnd.choices(b"ab", k=rnd.randint(1, 40)))
        raw = b"".join(rnd.choice([unit * rnd.randint(1, 30), bytes(rnd.choices(b"ab", k=rnd.randint(1, 300)))]) for _ in range(8))
        if len(raw) < length:
            continue
        at = np.array(sorted(rnd.sample(range(len(raw) - length + 1), min(400, len(raw) - length + 1))), np.int64)
        known = np.array([rnd.random() < 0.02 for _ in at])
        strings = [raw[k : k + length] for k in at.tolist()]
        seen, told = collections.Counter(strings), {x for x, k in zip(strings, known) if k}
        assert s.repeated(np.frombuffer(raw, np.uint8), at, length, known).tolist() == [seen[x] > 1 or x in told for x in strings]


def test_ranks_are_in_text_order():
    import numpy as np

    raw = bytes(random.Random(5).choices(range(256), k=3000))
    at = np.arange(2900)
    for n in (5, 8, 13, 23):
        rank = s._ranked(np.frombuffer(raw, np.uint8), at, n)
        assert sorted(at.tolist(), key=lambda k: (raw[k : k + n], k)) == sorted(at.tolist(), key=lambda k: (int(rank[k]), k))


def test_equal_strings_have_equal_anchors():
    import numpy as np

    rnd = random.Random(6)
    same = bytes(rnd.choices(b"abc", k=900))
    ends = []
    for before in (b"", b"xy" * 37):
        raw = np.frombuffer(before + same + bytes(rnd.choices(b"abc", k=500)), np.uint8)
        first, count, anchor = s._runs(raw, np.ones(len(raw), bool) & (np.arange(len(raw)) <= len(raw) - 400), 400)
        owner = np.repeat(anchor, count)
        ends.append(owner[len(before) : len(before) + 501].tolist())
    assert ends[0] == ends[1]


def test_block_sends_two_of_a_sample_and_one_of_a_segment():
    """A string in very many places of a block leaves it as two names and one segment."""
    import numpy as np
    import pyarrow as pa

    raw, length = b"x" * 5000 + bytes(random.Random(2).choices(range(97, 123), k=800)), 400
    places = len(raw) - length + 1
    mask = np.packbits(np.r_[np.ones(places, bool), np.zeros(length - 1, bool)])
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([[len(raw)]], pa.list_(pa.int64())), pa.array([s._zipped(raw)], pa.binary()), pa.array([mask.tobytes()], pa.binary())], ["block", "ends", "data", "mask"])
    sent = [x for out in s._samples(length, 3)(iter([batch])) for b in out.column("packed").to_pylist() for x in zip(*s.unpack(b, ["<u4", "<u2"])[0])]
    assert max(collections.Counter(sent).values()) == 2
    rows = [r for out in s._segments(length)(iter([batch])) for r in out.to_pylist()]
    assert len({r["segment"] for r in rows}) == len(rows) and [r["many"] for r in rows if r["segment"] == b"x" * 400] == [True]
    assert {r["segment"][k : k + length] for r in rows for k in range(len(r["segment"]) - length + 1)} == {raw[k : k + length] for k in range(places)}
