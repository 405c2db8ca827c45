"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps a score-ordered agenda of adjacent symbol pairs: the pair whose joined piece
has the best score merges first, the leftmost on a tie, until no pair forms a piece. Symbols that
are no piece fall back to byte pieces. Where no piece of the vocabulary has a space mark after
another character, no merge crosses from one space-marked chunk to the next, so the chunks of a
text are encoded one by one and their ids are remembered; else a text is one chunk. In each Arrow
batch every chunk that the task has not met before is compared with the sentencepiece library (by
itself, or within its whole text and with the decoded text), and a difference stops the job.

Defined results: a null text counts as empty; an empty text has no ids and decodes to ""; texts
of any length are encoded whole; repeated rows give repeated results; only the id and text
columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
MEMO_BYTES, MEMO_CHARS, MEMO_ENTRY = 100 << 20, 48, 200  # of a task's memo, as estimated; bytes of an entry besides its text and ids
WHOLE_ONE_IN = 32  # texts of a batch, by their place in it, that are compared with the library as a whole
SHORT = 24  # symbols
STRANGE = 1 << 24  # a character that is no piece is this plus its code point, in the lock step
NONE, SLOTS, SPREAD = 2**31 - 1, 1 << 20, np.int64(-7046029254386353131)  # the last spreads keys over slots


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message."""
    i, n = 0, len(buf)

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, buf[i : i + size]
            i += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", buf[i : i + size])[0]
            i += size


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    unk_surface: str = " ⁇ "
    ids: dict[str, int] = field(default_factory=dict)
    reserved: dict[str, int] = field(default_factory=dict)
    byte_ids: dict[int, int] = field(default_factory=dict)
    unk: int = 0

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            raw = f.read()
        pieces, scores, types, conf = [], [], [], {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece.get(1, b"").decode())
                scores.append(piece.get(2, 0.0))
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                if spec.get(3, 1) != 2 or spec.get(24, 0):
                    raise ValueError("only merge-type models with prefix space marks are supported")
                if 44 in spec:
                    conf["unk_surface"] = spec[44].decode()
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2, b""):
                    raise ValueError("the model's normalizer has a character map; only identity is supported")
                conf |= {"add_dummy_prefix": bool(spec.get(3, 1)), "remove_extra_whitespaces": bool(spec.get(4, 1)), "escape_whitespaces": bool(spec.get(5, 1))}
        return cls(pieces, scores, types, **conf)._index()

    def _index(self) -> Model:
        for i, (piece, kind) in enumerate(zip(self.pieces, self.types)):
            if kind in (NORMAL, USER_DEFINED, UNUSED):
                self.ids.setdefault(piece, i)
            else:
                self.reserved.setdefault(piece, i)
            if kind == BYTE:
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unk = i
        if any(k in (USER_DEFINED, UNUSED) for k in self.types):
            raise ValueError("user-defined or unused pieces are not supported")
        if self.remove_extra_whitespaces or not self.escape_whitespaces:
            raise ValueError("white space folding is not supported")
        self.lone = "".join(chr(c) for c in range(128) if chr(c) not in "".join(self.ids)) + "\0"  # no piece has them: no merge crosses them
        lone, spaced = re.escape(self.lone), any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        if spaced:
            self.lone = ""  # chunks can't be told apart
        self.chunks = re.compile(r"(?s).+" if spaced else f"{SPACE}+[^{SPACE}{lone}]*|[{lone}]|[^{SPACE}{lone}]+")
        self.surface = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else self.unk_surface.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.types)]
        self.controls = frozenset(i for i, k in enumerate(self.types) if k == CONTROL)
        self.digits = [str(i) for i in range(len(self.pieces))]
        self._index_pairs()
        return self

    def _index_pairs(self) -> None:
        """Tables for the lock step: character ids, and the rank of each pair of pieces that
        join to a piece, in an open hash table."""
        order = {score: k for k, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.slot_keys = np.full(SLOTS, -1, dtype=np.int64)
        self.slot_pieces, self.slot_ranks = np.full(SLOTS + 1, -1, dtype=np.int32), np.full(SLOTS + 1, NONE, dtype=np.int32)
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    key = a << 32 | b
                    slot = ((key * int(SPREAD) + 2**63) % 2**64 - 2**63 >> 44) & (SLOTS - 1)
                    while self.slot_keys[slot] >= 0:
                        slot = slot + 1 & (SLOTS - 1)
                    self.slot_keys[slot], self.slot_pieces[slot], self.slot_ranks[slot] = key, i, order[self.scores[i]]

    def normalize(self, text: str) -> str:
        return (SPACE if self.add_dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a normalized chunk, by the agenda."""
        symbols = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids, scores = self.ids, self.scores
        agenda: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            piece = symbols[left] + symbols[right]
            at = ids.get(piece)
            if at is not None:
                heapq.heappush(agenda, (-scores[at], left, right, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != len(piece):  # one of them has merged meanwhile
                continue
            symbols[left], symbols[right] = piece, ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                offer(left, nxt)
            if before[left] >= 0:
                offer(before[left], left)
        return self._pieces([s for s in symbols if s])

    def encode_chunks(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """encode_chunk for many chunks. Short ones of known characters advance in lock step:
        each step takes the best pair off every chunk's agenda, which for a few symbols is a row
        of ranks whose first least entry is the leftmost best pair."""
        out: list[tuple[int, ...] | None] = [None] * len(chunks)
        short = [i for i, c in enumerate(chunks) if len(c) <= SHORT]
        sizes = np.array([len(chunks[i]) for i in short], dtype=np.int64)
        points = np.frombuffer("".join([chunks[i] for i in short]).encode("utf-32-le"), dtype=np.uint32)
        known = self.char_ids[points]
        sym = np.full((len(short), SHORT + 2), -1, dtype=np.int32)  # a column of none before and after
        sym[:, 1:-1][np.arange(SHORT)[None, :] < sizes[:, None]] = np.where(known < 0, STRANGE + points.astype(np.int32), known)
        self._merge_rows(sym)
        alive = sym >= 0
        flat, cuts = sym[alive].tolist(), np.r_[0, np.cumsum(alive.sum(1))].tolist()
        odd = (sym >= STRANGE).any(1).tolist()
        for k, i in enumerate(short):
            ids = flat[cuts[k] : cuts[k + 1]]
            out[i] = self._pieces([self.pieces[x] if x < STRANGE else chr(x - STRANGE) for x in ids]) if odd[k] else tuple(ids)
        return [x if x is not None else self.encode_chunk(c) for c, x in zip(chunks, out)]

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that two symbols form and its rank; rank NONE if they form none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slot = key * SPREAD >> 44 & (SLOTS - 1)
        at = np.where(self.slot_keys[slot] == key, slot, SLOTS)
        open_ = np.flatnonzero((at == SLOTS) & (self.slot_keys[slot] >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (SLOTS - 1)
            have = self.slot_keys[slot[open_]]
            hit = have == key[open_]
            at[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (have >= 0)]
        return self.slot_pieces[at], self.slot_ranks[at]

    def _merge_rows(self, sym: np.ndarray) -> None:
        n, width = sym.shape
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        ranks, pieces = np.full((n, width), NONE, dtype=np.int32), np.full((n, width), -1, dtype=np.int32)
        x, y = np.nonzero((sym[:, :-1] >= 0) & (sym[:, 1:] >= 0))
        pieces[x, y], ranks[x, y] = self._joined(sym[x, y], sym[x, y + 1])
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(1)
            go = ranks[rows, at] < NONE
            rows, at = rows[go], at[go]
            gone = after[rows, at]
            nxt, prv = after[rows, gone], before[rows, at]
            sym[rows, at] = new = pieces[rows, at]
            sym[rows, gone] = -1
            after[rows, at], before[rows, nxt] = nxt, at
            ranks[rows, gone] = NONE
            pieces[rows, at], ranks[rows, at] = self._joined(new, sym[rows, nxt])
            pieces[rows, prv], ranks[rows, prv] = self._joined(sym[rows, prv], new)

    def _pieces(self, symbols: list[str]) -> tuple[int, ...]:
        out: list[int] = []
        for s in symbols:
            at = self.reserved.get(s, self.ids.get(s))
            if at is not None and at != self.unk:
                out.append(at)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode()]
            else:
                out.append(self.unk)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks.findall(self.normalize(text)) for i in self.encode_chunk(c)]

    def decode(self, ids: list[int]) -> str:
        if not self.controls.isdisjoint(ids):
            return self._decode_broken(ids)
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        if self.add_dummy_prefix:
            if ids and self.types[ids[0]] not in (BYTE, UNKNOWN) and raw[:1] == b" ":
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: list[int]) -> str:
        """As decode, for runs of byte pieces that are not UTF-8: each bad byte becomes U+FFFD."""
        out, run, first = [], bytearray(), True

        def flush() -> None:
            i = 0
            while i < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + size]).decode())
                        i += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids:
            if self.types[i] == BYTE:
                run += self.surface[i]
                first = False
                continue
            flush()
            if self.types[i] == CONTROL:
                continue
            s = self.surface[i].decode()
            out.append(s[1:] if first and self.add_dummy_prefix and self.types[i] != UNKNOWN and s[:1] == " " else s)
            first = False
        flush()
        return "".join(out)


@functools.cache
def _loaded(path: str) -> tuple:
    import sentencepiece

    return Model.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


class Codec:
    """A task's encoder: the model, a memo of chunks and the library to check against. Ids are kept
    as the bytes of an array, so that a text's ids are joined from its chunks' without an object
    each. The memo is bounded in bytes and goes with the task.

    check: every chunk that is new to the memo is compared with the library, one that begins with a
    space mark as a text of its own, any other behind a line feed, which joins nothing. Of the
    texts one in WHOLE_ONE_IN is compared whole, with its decoded text. (All of them would need
    some 1,500 CPU seconds a GB.) Where chunks can't be told apart so, whole texts are compared."""

    def __init__(self, path: str, check: bool = True):
        self.model, self.library = _loaded(path)
        self.memo: dict[str, bytes] = {}
        self.held, self.check = 0, check
        self.apart = self.model.add_dummy_prefix and "\n" in self.model.lone
        self.feed = len(self.library.encode("\n")) if self.apart else 0
        self.kind = "H" if len(self.model.pieces) < 1 << 16 else "I"

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        model, memo = self.model, self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        found, fresh, whole = [], set(), []
        for k, text in enumerate(texts):
            chunks = model.chunks.findall(model.normalize(text or ""))
            ids = list(map(memo.get, chunks))
            if None in ids:
                fresh.update([c for c, x in zip(chunks, ids) if x is None])
            if self.check and (k % WHOLE_ONE_IN == 0 or not self.apart and None in ids):
                whole.append(k)
            found.append((chunks, ids))
        names = list(fresh)
        new = {c: array(self.kind, ids).tobytes() for c, ids in zip(names, model.encode_chunks(names))}
        if self.check and self.apart:
            self._compare([c for c in names if c[0] == SPACE and len(c) > 1], new, "", 0)
            self._compare([c for c in names if c[0] != SPACE], new, "\n", self.feed)
        kept = {c: ids for c, ids in new.items() if len(c) <= MEMO_CHARS}
        memo.update(kept)
        self.held += sum(MEMO_ENTRY + 2 * len(c) + len(x) for c, x in kept.items())
        out = [np.frombuffer(b"".join([new[c] if x is None else x for c, x in zip(chunks, ids)] if None in ids else ids), self.kind).tolist() for chunks, ids in found]
        for k, want in zip(whole, self.library.encode([texts[k] or "" for k in whole], num_threads=1) if whole else []):
            if want != out[k] or self.library.decode(want) != model.decode(want):
                raise ValueError(f"the agenda and the library differ on {(texts[k] or '')[:80]!r}")
        return iter(out)

    def _compare(self, chunks: list[str], got: dict[str, bytes], front: str, skip: int) -> None:
        plain = [front + (c if front else c[1:]).replace(SPACE, " ") for c in chunks]
        for c, want in zip(chunks, self.library.encode(plain, num_threads=1) if plain else []):
            if array(self.kind, want[skip:]).tobytes() != got[c]:
                raise ValueError(f"the agenda and the library differ on {c[:80]!r}")


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """The other columns of docs, and ids array<int>, n_tokens and decoded: every text encoded and
    decoded again. Columns of docs by these three names are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path, check)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, flat, texts = [0], [], []
                for ids in codec.encode_batch(batch.column(1).to_pylist()):
                    flat.append(np.array(ids, np.int32))
                    sizes.append(sizes[-1] + len(ids))
                    texts.append(codec.model.decode(ids))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(sizes), pa.int64()), pa.array(texts, pa.string())], ["rest", "ids", "n_tokens", "decoded"])

    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "ids", "n_tokens", "decoded")]).alias("rest"), F.col(text_col).alias("text"))
    out = src.mapInArrow(run, f"rest {src.schema['rest'].dataType.simpleString()}, ids array<int>, n_tokens long, decoded string")
    return out.select("rest.*", "ids", "n_tokens", "decoded")


def digests(docs: DataFrame, model_path: str, check: bool = True) -> DataFrame:
    """Per document the number of ids and digests of ids and decoded text; ids and texts stay
    inside the Python worker, so only digests cross back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path, check)
        digits, decode = codec.model.digits, codec.model.decode
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, a, b = [], [], []
                for ids in codec.encode_batch(batch.column(1).to_pylist()):
                    n.append(len(ids))
                    a.append(sha(",".join([digits[i] for i in ids])))
                    b.append(sha(decode(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
