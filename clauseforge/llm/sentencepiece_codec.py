"""SentencePiece encoding and decoding, lossless, from a model file.

An Aho-Corasick automaton over the pieces is run once over a chunk of text; at
each position its output links name every piece that ends there, and each is
relaxed against the best path to where it starts.

* unigram models: a path's score is the sum of its pieces' scores.
* BPE models: pieces' scores rank merges, so a sum of them would not give the
  model's segmentation.  A step from piece p to piece t is admitted only if the
  merges leave "p t" as these two pieces; by the locality of merges exactly one
  path of admitted steps reaches each position, and it is the BPE encoding.

No piece has the space mark after another character (checked when the model is
loaded), so text splits before each run of spaces without changing any result,
and the chunks are memoised in a bounded cache."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.storage import give_back

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SEEN = 1 << 20  # classes of chunks of which is known whether one came before
CACHE = 300_000  # memoised chunks of at most 64 characters in a Python worker

# Fixed values of the model file's format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        else:
            size = 8 if key & 7 == 1 else 4
            yield key >> 3, raw[at : at + size]
            at += size


class _Memo(dict):
    """Values of the keys that came before: most come once and never again, so a key is
    held from its second time on.  ``seen`` has a byte a class of keys."""

    def __init__(self, make, keep):
        super().__init__()
        self.make, self.keep = make, keep
        self.seen, self.n_seen = bytearray(SEEN), 0

    def __missing__(self, key):
        value = self.make(key)
        if self.keep(key):
            at = hash(key) % SEEN
            if self.seen[at]:
                if len(self) >= CACHE:
                    self.clear()
                self[key] = value
            else:
                if self.n_seen >= SEEN // 2:
                    self.seen, self.n_seen = bytearray(SEEN), 0
                self.seen[at] = 1
                self.n_seen += 1
        return value


class Codec:
    """Encoder and decoder of one model (its file's bytes)."""

    def __init__(self, model: bytes):
        pieces: list[tuple[str, float, int]] = []
        kind, dummy, collapse, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                piece, score, type_ = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        type_ = v
                pieces.append((piece, score, type_))
            elif number == 2:
                kind = next((v for n, v in _fields(value) if n == 3), UNIGRAM)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        dummy = bool(v)
                    elif n == 4:
                        collapse = bool(v)
        if charsmap or collapse:
            raise ValueError("models that normalise text are not lossless and not supported")
        if kind not in (UNIGRAM, BPE) or any(t == USER_DEFINED for _, _, t in pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.kind, self.dummy = kind, dummy
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback, so decoding would lose text")
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, UNUSED) and p}
        self.scores = [s for _, s, _ in pieces]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode()
            for p, _, t in pieces
        ]
        self.worst = min((pieces[i][1] for i in self.ids.values()), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.automaton.add_word(p, (len(p), k))
        self.automaton.make_automaton()
        self.chars = {p for p in self.ids if len(p) == 1}
        self.names = [p for p, _, _ in pieces] + [""]
        self.start = len(pieces)
        self.follows = _Memo(lambda k: self._apart(self.names[k // (self.start + 1)], self.names[k % (self.start + 1)]), lambda k: True)
        splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        newline = "" if any("\n" in p for p in self.ids) else "\n"
        self.chunks = re.compile(f"{newline and newline + '|'}{SPACE}*[^{SPACE}{newline}]+|{SPACE}+").findall if splits else lambda s: [s]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo = _Memo(self._encode, lambda k: len(k) <= 64)

    def _merged(self, text: str) -> list[str]:
        """A short text's pieces after all merges: best score first, then leftmost."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, left: str, right: str) -> bool:
        return self._merged(left + right) == ([left, right] if left else [right])

    def _stays(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 2 * CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(left, right)
        return found

    def _path(self, text: str) -> list[str]:
        n = len(text)
        back: list[str | None] = [None] * (n + 1)
        if self.kind == BPE:
            back[0] = ""
            stays, pairs = self._stays, self.pairs
            ends = _Ends(self.automaton, text)
            for j in range(1, n + 1):
                for size in ends.at(j):
                    left, right = back[j - size], text[j - size : j]
                    ok = pairs.get((left, right))
                    if stays(left, right) if ok is None else ok:
                        back[j] = right
                        break
        else:
            best = [0.0] + [-float("inf")] * n
            ends = _Ends(self.automaton, text)
            for j in range(1, n + 1):
                for size in ends.at(j):
                    piece = text[j - size : j]
                    k = self.ids.get(piece)
                    score = best[j - size] + (self.worst if k is None else self.scores[k])
                    if score > best[j]:
                        best[j], back[j] = score, piece
        out, j = [], n
        while j:
            out.append(back[j])
            j -= len(back[j])
        return out[::-1]

    def _known(self, text: str) -> bytes:
        """A chunk's BPE ids where each of its characters is a piece."""
        n, base, follows, none = len(text), self.start + 1, self.follows, -1
        back = [none] * (n + 1)
        back[0] = self.start
        sizes = [0] * (n + 1)
        for end, (size, k) in self.automaton.iter(text):
            end += 1
            if back[end] < 0:
                left = back[end - size]
                if left >= 0 and follows[left * base + k]:
                    back[end], sizes[end] = k, size
        out = []
        while n:
            out.append(back[n])
            n -= sizes[n]
        return struct.pack(f"<{len(out)}i", *reversed(out))

    def _encode(self, text: str) -> bytes:
        """Ids of a chunk, as int32 bytes."""
        if self.kind == BPE and self.chars.issuperset(text):
            return self._known(text)
        out: list[int] = []
        for p in self._path(text):
            k = self.ids.get(p)
            if k is None:
                out.extend(self.byte[b] for b in p.encode())
            else:
                out.append(k)
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text.  Empty or null: none.  A literal space mark in
        the text becomes bytes, so that decoding can tell it from a space."""
        if not text:
            return np.zeros(0, np.int32)
        parts = text.split(SPACE)
        mark = np.array([self.byte[b] for b in SPACE.encode()], np.int32).tobytes()
        out = []
        for i, part in enumerate(parts):
            if i:
                out.append(mark)
            s = (SPACE if self.dummy and not i else "") + part.replace(" ", SPACE)
            out.extend(map(self.memo.__getitem__, self.chunks(s)))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        """The text of ids; unknown and control pieces have none."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


class _Ends:
    """Sizes of the pieces ending at each position, longest first; the single
    character always counts, as merges start from it."""

    def __init__(self, automaton, text: str):
        self.found: list[list[int]] = [[] for _ in range(len(text) + 1)]
        for end, (size, _) in automaton.iter(text):
            self.found[end + 1].append(size)

    def at(self, j: int) -> list[int]:
        sizes = self.found[j]
        if 1 not in sizes:
            sizes.append(1)
        return sizes


_CODECS: dict[str, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec a model in each Python process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL
) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row per row; no shuffle.  A null text has
    null ids, an empty one an empty array.  Further columns are ignored."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = b.column(1)
            for at in range(0, len(texts), 256):  # arrays of long texts stay small
                part = [c.encode(x.as_py()) if x.is_valid else None for x in texts[at : at + 256]]
                none = np.array([p is None for p in part], bool)
                sizes = np.array([0 if p is None else len(p) for p in part], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.concatenate([p for p in part if p is not None] or [np.zeros(0, np.int32)])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 256], ids], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>"
    )


def decode_documents(
    encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = DEFAULT_MODEL
) -> DataFrame:
    """``(doc_id, text)`` back from ids; null ids give a null text."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = [c.decode(x.values.to_numpy()) if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"doc_id {kind}, text string"
    )


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL
) -> DataFrame:
    """Encode every whole text, decode the ids again, in one pass: ``(doc_id, ids,
    n_tokens, decoded_sha256, round_trip)``.  A null text has null ids, n_tokens
    0 and a null digest and counts as kept; an empty one has no ids."""
    model = read_model(model_path)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        names = ["doc_id", "ids", "n_tokens", "decoded_sha256", "round_trip"]
        for b in batches:
            texts = b.column(1)
            for at in range(0, len(texts), 256):
                ids, digests, same = [], [], []
                for x in texts[at : at + 256]:
                    text = x.as_py()
                    if text is None:
                        ids.append(None)
                        digests.append(None)
                        same.append(True)
                        continue
                    got = c.encode(text)
                    back = c.decode(got)
                    ids.append(got)
                    digests.append(hashlib.sha256(back.encode()).hexdigest())
                    same.append(back == text)
                none = np.array([p is None for p in ids], bool)
                sizes = np.array([0 if p is None else len(p) for p in ids], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.concatenate([p for p in ids if p is not None] or [np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[at : at + 256],
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(none)),
                        pa.array(sizes),
                        pa.array(digests, pa.string()),
                        pa.array(same),
                    ],
                    names,
                )
            del texts, b
            give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
