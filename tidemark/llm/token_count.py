"""Token counts under a unigram vocabulary, by a Viterbi pass that carries a score and a piece count only.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character, longest first. That is the order in
which the usual forward search meets them, so keeping the first of equal scores is the tokenizer's own tie rule. A
character that is no piece costs the least score minus 10 and counts as its UTF-8 bytes (byte fallback) or as one.
Scores are summed in doubles.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct chunks that a Python worker remembers, and the longest one worth it.
CACHE_CHUNKS = 400_000
CACHE_CHUNK_CHARS = 48


@dataclass(frozen=True)
class UnigramVocabulary:
    """Pieces with scores; `byte_fallback`: a character outside is spelled in bytes."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True

    @classmethod
    def from_sentencepiece(cls, path: str) -> UnigramVocabulary:
        """The normal pieces of a model file and their scores; control and byte pieces match no text."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        own = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return cls(tuple((m.id_to_piece(i), m.get_score(i)) for i in own), any(map(m.is_byte, ids)))


class Counter:
    def __init__(self, vocab: UnigramVocabulary):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocab.pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min((s for _, s in vocab.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = vocab.byte_fallback
        # Where no piece has a space mark after another character, no piece crosses the start of a word.
        apart = not any(SPACE in p.lstrip(SPACE) for p, _ in vocab.pieces)
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if apart else lambda t: [t]
        self.known: dict[str, tuple[int, float]] = {}

    def chunk(self, text: str) -> tuple[int, float]:
        score, count = [0.0], [0]  # by end
        top = None  # best score so far of the end being filled
        pieces, single = 0, False  # its count; is one of the pieces that end here a single character?
        for last, (size, own) in self.auto.iter(text):
            while len(score) <= last:
                if not single:
                    top, pieces = self._unknown(text[len(score) - 1], top, pieces, score[-1], count[-1])
                score.append(top)
                count.append(pieces)
                top, single = None, False
            s = score[last + 1 - size] + own
            if top is None or s > top:
                top, pieces = s, count[last + 1 - size] + 1
            single = single or size == 1
        while len(score) <= len(text):
            if not single:
                top, pieces = self._unknown(text[len(score) - 1], top, pieces, score[-1], count[-1])
            score.append(top)
            count.append(pieces)
            top, single = None, False
        return count[-1], score[-1]

    def _unknown(self, char: str, top: float | None, pieces: int, score: float, count: int) -> tuple[float, int]:
        """A lone unknown character comes after all pieces that end with it."""
        s = score + self.unknown
        return (top, pieces) if top is not None and top >= s else (s, count + (len(char.encode()) if self.bytes else 1))

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        total, best, known = 0, 0.0, self.known
        for c in self.split(SPACE + text.replace(" ", SPACE)):
            got = known.get(c)
            if got is None:
                got = self.chunk(c)
                if len(c) <= CACHE_CHUNK_CHARS:
                    if len(known) >= CACHE_CHUNKS:
                        known.clear()
                    known[c] = got
            total += got[0]
            best += got[1]
        return total, best


_COUNTERS: dict[int, Counter] = {}


def count_tokens(df: DataFrame, vocab: UnigramVocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, score double) of every whole text; no shuffle, one Arrow pass.

    Null and empty texts give 0 tokens and score 0. Rows are kept one for one, repeated ones included; other columns are
    dropped, so their names cannot clash. An empty table gives an empty one.
    """
    data = pickle.dumps(vocab)
    if len(data) > MAX_BROADCAST_BYTES:
        raise ValueError("the vocabulary is too large to hand to every executor")
    shared = df.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hash(shared.value) not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[hash(shared.value)] = Counter(pickle.loads(shared.value))
        counter = _COUNTERS[hash(shared.value)]
        for batch in batches:
            found = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["k", "n_tokens", "score"])

    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(run, f"k {kind}, n_tokens long, score double").withColumnRenamed("k", key)
