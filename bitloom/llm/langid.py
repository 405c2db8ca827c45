"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is lower-cased and white space becomes one blank; its subwords are all byte n-grams of
N_GRAMS sizes without an inner blank, hashed to BUCKETS embeddings. Their average goes through a
linear layer and a softmax. Embeddings and layer are trained in numpy by stochastic gradient
descent on a bounded sample: at most about `per_language` labelled documents of each language,
chosen by a hash of their id; of a text of more than `sample_chars` characters pieces of
`piece_chars` are taken evenly from all over it, `sample_chars` in all. A fifth of the sample is kept from training; on it the softmax temperature is fitted
and the rejection threshold is set, the least score above which `precision` of the answers are
right. Every whole text is then scored on the executors with one table of BUCKETS x languages.

Defined results: a null text and one without a letter is "und" with score 0; a document without a
doc_id is not held out but never trained on; if no language has a training text every text is
"und"; every lang value is learned, and a ValueError tells of more than `max_languages`, as the table
would not fit on an executor; repeated rows are each learned and scored; of equal scores the
language first in the alphabet is predicted; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, DIM, N_GRAMS = 1 << 16, 16, (1, 2, 3, 4, 5)
PER_LANGUAGE, SAMPLE_CHARS, PIECE_CHARS, MAX_LANGUAGES = 800, 1200, 240, 200
EPOCHS, BATCH, RATE, PRECISION = 3, 64, 12.0, 0.995
TILE = 1 << 20
LETTER, BLANKS = re.compile(r"[^\W\d_]"), re.compile(r"\s+")


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket ids of all subwords, a tile of the text at a time."""
    raw = np.frombuffer((" " + BLANKS.sub(" ", text.lower()).strip() + " ").encode(), np.uint8)
    for lo in range(0, len(raw), TILE):
        tile = raw[lo : lo + TILE + max(N_GRAMS) - 1]
        blank = np.r_[0, np.cumsum(tile == 32)]
        h, out = np.zeros(len(tile), np.uint32), []
        for n in range(1, max(N_GRAMS) + 1):
            m = min(TILE, len(tile) - n + 1)
            if m <= 0:
                break
            h = h[:m] * np.uint32(16777619) ^ tile[n - 1 : n - 1 + m]
            if n in N_GRAMS:
                inner = blank[n - 1 : n - 1 + m] - blank[1 : 1 + m] if n > 1 else tile[:m] == 32
                own = h[inner <= 0] if n > 1 else h[~inner]
                out.append((own + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        yield np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for ids in subwords(text):
            total += self.table[ids].sum(0, dtype=np.float64)
            n += len(ids)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, False
        p = softmax(self.logits(text)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(examples: list[tuple[str, str]], seed: int = 7) -> Model:
    """From (language, text) pairs, the last fifth of which calibrates."""
    languages = sorted({k for k, _ in examples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    number = {k: i for i, k in enumerate(languages)}
    cut = len(examples) - len(examples) // 5
    pieces = [(number[k], t[i : i + PIECE_CHARS]) for k, t in examples[:cut] for i in range(0, len(t), PIECE_CHARS)]
    ids = [np.concatenate(list(subwords(t))) for _, t in pieces]
    wanted = np.array([k for k, _ in pieces])
    weight = (len(pieces) / len(languages) / np.bincount(wanted, minlength=len(languages)).clip(1))[wanted]
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, at = EPOCHS * -(-len(pieces) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order), BATCH):
            rate = RATE * (1 - at / steps)
            at += 1
            own = order[lo : lo + BATCH]
            sizes = np.array([len(ids[i]) for i in own])
            flat, row = np.concatenate([ids[i] for i in own]), np.repeat(np.arange(len(own)), sizes)
            mean = np.add.reduceat(embed[flat], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None]
            grad = softmax(mean @ layer + bias)
            grad[np.arange(len(own)), wanted[own]] -= 1
            grad = (grad * weight[own, None] / len(own)).astype(np.float32)
            back = grad @ layer.T / sizes[:, None].astype(np.float32)
            layer -= rate / 10 * (mean.T @ grad).astype(np.float32)
            bias -= rate / 100 * grad.sum(0)
            for d in range(DIM):
                embed[:, d] -= rate * np.bincount(flat, back[row, d], minlength=BUCKETS).astype(np.float32)
    model = Model(languages, (embed @ layer).astype(np.float32), bias.astype(np.float64))
    return calibrate(model, examples[cut:] or examples)


def calibrate(model: Model, examples: list[tuple[str, str]]) -> Model:
    held = [(model.languages.index(k), model.logits(t)) for k, t in examples if k in model.languages and LETTER.search(t)]
    if not held:
        return model
    truth, logits = np.array([k for k, _ in held]), np.stack([x for _, x in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth].clip(1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(logits / model.temperature)
    right, score = p.argmax(1) == truth, p.max(1)
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= PRECISION)
    model.threshold = float(score[order][good[-1]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS, max_languages: int = MAX_LANGUAGES) -> list[tuple[str, str]]:
    """(lang, text) of the bounded training sample, in an order that only ids decide. docs has
    doc_id, text and lang; rows with a null or an empty text are left out."""
    ready = docs.where("doc_id is not null and lang is not null and text <> ''")
    counts = ready.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"there are more than {max_languages} languages")
    order = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    share = F.lit(None).cast("long")
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, per_language / r["count"]) * (1 << 40)))).otherwise(share)
    n = max(2, sample_chars // PIECE_CHARS)
    place = lambda i: (1 + F.floor(i * (F.length("text") - PIECE_CHARS) / (n - 1))).cast("int")
    pieces = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(F.col("text"), place(i), F.lit(PIECE_CHARS))), " ")
    rows = ready.where(order < share).select("lang", F.when(F.length("text") > sample_chars, pieces).otherwise(F.col("text")).alias("text"), order.alias("o")).collect()
    return [(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["o"], r["lang"], r["text"]))]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row; only doc_id and text are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x max_languages floats at most
    names = ["doc_id", "held_out", "lang_pred", "score", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sent.value.predict(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, and predict all."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return identify(docs, train(sample(docs.where(~held_out()))))
