"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end its BPE encoding. The table of these last tokens is filled
from left to right: a token that ends at byte i is the last one if it and the last token of the prefix before it form a
pair that BPE leaves unmerged. Reading the table backwards gives the encoding; appending bytes only adds entries, and
an edit recomputes entries from the edited byte on until they agree with the old ones again.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, read_driver_file

#: Distinct pieces that a Python worker remembers, and UTF-8 bytes of text that it takes at a time (or one text).
CACHE_PIECES = 500_000
CHUNK_BYTES = 2 << 20
#: Pairs of tokens whose test a worker remembers.
CACHE_PAIRS = 500_000


class Vocabulary:
    """Token bytes by rank, with the tests that the dynamic program needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        size = max(self.tokens, default=0) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    @classmethod
    def from_tiktoken(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in data.splitlines() if line)})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (token, token) for one byte; None if merging never makes it."""
        if token not in self._parts:
            text = self.tokens[token]
            if len(text) == 1:
                found = (token, token)
            else:
                halves = self._merge(text, stop=2)
                found = (self.ranks[halves[0]], self.ranks[halves[1]]) if len(halves) == 2 else None
            self._parts[token] = found
        return self._parts[token]

    def _merge(self, text: bytes, stop: int) -> list[bytes]:
        """Plain BPE on a token's own bytes, halted at `stop` parts."""
        seq = [text[i : i + 1] for i in range(len(text))]
        while len(seq) > stop:
            rank, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(seq, seq[1:]))))
            if rank == 1 << 60:
                break
            seq[at : at + 2] = [seq[at] + seq[at + 1]]
        return seq

    def fill(self, data: bytes, last: list[int], start: int) -> None:
        """Appends the last token of each prefix of `data` longer than `start` to `last`."""
        get, parts, pairs, longest = self.ranks.get, self._parts, self._pairs, self.longest
        for end in range(start + 1, len(data) + 1):
            # one token fits, so the order is free: short ones are found first as a rule
            for begin in range(end - 1, max(end - longest, 0) - 1, -1):
                token = get(data[begin:end])
                if token is None or (parts[token] if token in parts else self.parts(token)) is None:
                    continue
                if not begin:
                    break
                pair = last[begin - 1] << 24 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self._adjacent(last[begin - 1], token)
                if fits:
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(token)

    def ids(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of `data`, read backwards off its table."""
        out, end, tokens = [], len(data), self.tokens
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(tokens[token])
        out.reverse()
        return out

    def _adjacent(self, left: int, right: int) -> bool:
        """Does BPE leave these two tokens side by side?"""
        # Undo merges, the youngest first. If at some moment the tokens that touch would merge earlier than the merge
        # just undone, BPE would have joined them across the border.
        before = 1 << 60
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < before:
                return False
            left_part, right_part = self.parts(left)[1], self.parts(right)[0]
            left_single, right_single = left_part == left, right_part == right
            if left_single and right_single:
                return True
            # of equal ranks the left one was merged first
            if right_single or (not left_single and left > right):
                before, left = left, left_part
            else:
                before, right = right + 1, right_part


class PrefixTable:
    """Last token of every prefix of a byte string, with exact appends and re-encoding near edits."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self.vocab.fill(self.data, self.last, start)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts `new` in place of bytes start:end; returns how many entries were recomputed."""
        data = self.data[:start] + new + self.data[end:]
        old, shift = self.last, len(new) - (end - start)
        last, run, pos = old[:start], 0, start
        while pos < len(data):
            pos += 1
            self.vocab.fill(data[:pos], last, pos - 1)
            was = pos - shift
            # an entry depends on the `longest` bytes and entries before it only
            run = run + 1 if was > end and last[-1] == old[was - 1] else 0
            if run >= self.vocab.longest and pos >= start + len(new) + self.vocab.longest:
                last += old[was:]
                break
        self.data, self.last = data, last
        return pos - start

    def ids(self) -> list[int]:
        return self.vocab.ids(self.data, self.last)


class Encoder:
    """Encodes whole texts: splits by a pattern, each piece by the dynamic program, recent pieces from memory.

    New pieces of a chunk are taken in sorted order, so that a piece goes on from the table of the prefix that it shares
    with the one before.
    """

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.find = vocab, regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        known, v = self.known, self.vocab
        before, last = b"", []
        for data, piece in sorted((p.encode(), p) for p in pieces):
            whole = v.ranks.get(data)
            if whole is not None:
                known[piece] = _PACK(whole)
                continue
            shared = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            v.fill(data, last, shared)
            before = data
            known[piece] = array("i", v.ids(data, last)).tobytes()
        return known

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        split = [self.find(t) for t in texts]
        known = self.known
        new = set(chain.from_iterable(split)).difference(known)
        if new:
            if len(known) + len(new) > CACHE_PIECES:
                known.clear()
                new = set(chain.from_iterable(split))
            known = self._learn(new)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        if len(known) > CACHE_PIECES:
            known.clear()
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_all([text])[0]).tolist()

    def decode_all(self, packed: list[bytes]) -> pa.Array:
        """The bytes that packed ids stand for, as one binary array."""
        v = self.vocab
        ids = np.frombuffer(b"".join(packed), np.int32)
        sizes = v.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(v.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])]
        return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(v.flat[at])])


_PACK = struct.Struct("i").pack
_VOCABULARIES: dict[int, Vocabulary] = {}
_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _vocabulary(data: bytes) -> Vocabulary:
    """One vocabulary, and below one encoder, for all tasks of a Python worker."""
    if hash(data) not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[hash(data)] = Vocabulary.from_tiktoken(data)
    return _VOCABULARIES[hash(data)]


def _encoder(data: bytes, pattern: str) -> Encoder:
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(_vocabulary(data), pattern)
    return _ENCODERS[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Token ids of every whole text: (key, ids array<int>); with `decoded` also the bytes that these ids stand for.

    No shuffle, one Arrow pass. Null and empty texts give an empty array; rows are kept one for one, repeated keys and
    rows included; other columns are dropped, so their names cannot clash. `ranks_path` is a rank file on the driver
    (checked to be small), `pattern` splits the text before merging. Special tokens are ordinary text.
    """
    data = df.sparkSession.sparkContext.broadcast(read_driver_file(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value, pattern)
        for keys, texts in chunks(batches, CHUNK_BYTES):
            packed = enc.encode_all(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32))
            cols = [keys, pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), np.int32)))]
            if decoded:
                cols.append(enc.decode_all(packed))
            yield pa.RecordBatch.from_arrays(cols, names=["k", "ids", "decoded"][: len(cols)])

    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(run, f"k {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("k", key)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for. Null ids give null; an id outside the vocabulary raises."""
    data = df.sparkSession.sparkContext.broadcast(read_driver_file(ranks_path))

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        get = _vocabulary(data.value).tokens.__getitem__
        return pa.array([None if x is None else b"".join(map(get, x)) for x in column.to_pylist()], pa.binary())

    return df.withColumn(out, run(F.col(ids)))
