import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from bitloom.llm import simhash

SCHEMA = "doc_id long, text string, source string, fp string, key long"


def brute(rows):
    """Component of every row by comparing all fingerprints."""
    fps = [(d, simhash.fingerprint(t)) for d, t in rows]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, format(f, "016x"), least[find(i)]) for i, (d, f) in enumerate(fps))


def run(spark, rows, block=simhash.BLOCK):
    df = spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], SCHEMA)
    return sorted(map(tuple, simhash.near_duplicates(df, block).select("doc_id", simhash.hexadecimal().alias("f"), "component_id").collect()))


def corpus(n=150, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(30, 400))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i * 7 + 1, " ".join(w)))
    return rows


def test_hash_is_bitwise_majority():
    import xxhash

    text = "A b  c\td"
    hs = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d")]
    assert simhash.fingerprint(text) == hs[0] & hs[1]
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0


@pytest.mark.parametrize("block", [simhash.BLOCK, 20])
def test_matches_brute_force(spark, block):
    rows = corpus() + [(5000, None), (5001, ""), (5002, " \t "), (5003, "one two"), (5004, "ONE  two"), (5004, "one two"), (5005, "x " * 30000)]
    assert run(spark, rows, block) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("size", [7, 100, 1000])
def test_adjacent_hot_keys_pass_whole(size):
    """However the sorted rows are cut into batches, a hot key's rows are all passed on."""
    counts = {1: 3, 2: 1300, 3: 800, 4: 1001, 5: 2, 6: 450}
    keys = np.repeat(list(counts), list(counts.values()))
    fps = np.random.default_rng(1).integers(0, 1 << 62, len(keys))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(fps[i : i + size])], ["key", "fp"]) for i in range(0, len(keys), size)]
    passed = {}
    for out in simhash._verify(400)(iter(batches)):
        for key, fp in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            if key is not None:
                passed.setdefault(key, []).append(fp)
    assert passed == {k: fps[keys == k].tolist() for k, n in counts.items() if n > 400}
