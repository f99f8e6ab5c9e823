"""Quality classifier: an interpolated modified Kneser-Ney model of characters per language, trained on trusted text.

Counts of all character 4-grams of the trusted documents are summed by (language, gram); lower orders count distinct left
neighbours; discounts come from the counts of counts. Joins by (language, context) shard turn counts into probabilities
and back-off weights. The model is written in files sorted by (language, order, gram); to score, the distinct grams of each block
of documents are merged with those shards whose ranges they meet, read from the shared folder: neither the driver nor a
broadcast ever holds the model. Documents whose perplexity is above a quantile of held-out trusted documents of their language are
rejected.

A quarter of the trusted texts, chosen by a hash of the text, is held out for the quantiles; the rest is trained on. Characters
beyond 16 bits share 6,400 codes, so that a gram fits 64 bits.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, fresh

ORDER = 4
FLOOR = 1e-5  # probability of a character never seen
QUANTILE = 0.995
DIGITS = 4  # of a loss; sums of floats in another order agree so far
HELD_OUT = 4
CHUNK_CHARS = 1 << 21
#: Entries of one file of the model (24 bytes each in memory), and the bytes of such files that a process keeps.
SHARD_ENTRIES, CACHE_BYTES = 250_000, 96 << 20
#: Trusted ids up to which they are broadcast (16 bytes each); beyond, documents and ids are joined by a shuffle, with equal results.
BROADCAST_IDS = 4_000_000
_END, _START = 3, 2


def _chars(text: str) -> np.ndarray:
    """16-bit codes with ORDER - 1 starts before and an end after; characters beyond 16 bits share private codes."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    a = np.where(a < 0x10000, a, 0xE000 + a % 0x1900)
    return np.concatenate([np.full(ORDER - 1, _START, np.uint64), a, [np.uint64(_END)]])


def _grams(text: str) -> np.ndarray:
    """The ORDER-gram that ends at each character, 16 bits a character."""
    a = _chars(text)
    n = len(a) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for j in range(ORDER):
        out = (out << np.uint64(16)) | a[j : j + n]
    return out


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with at most CHUNK_CHARS characters (or one row), and their texts, null as empty."""
    for b in batches:
        texts = b.column(column)
        ends = np.cumsum(pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_CHARS, "right")))
            yield b.slice(at, to - at), [t or "" for t in texts.slice(at, to - at).to_pylist()]
            at = to


def _count(trusted: DataFrame) -> DataFrame:
    """(lang, gram, c) over all rows of (lang, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                c = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "gram", "c"])
            held.clear()

        for b, texts in _runs(batches, "t"):
            langs = b.column("lang").to_pylist()
            for lang in set(langs):
                g, c = np.unique(np.concatenate([_grams(t) for t, x in zip(texts, langs) if x == lang]), return_counts=True)
                held.setdefault(lang, []).append((g, c))
            if sum(len(p[0]) for parts in held.values() for p in parts) > 3_000_000:
                yield from flush()
        yield from flush()

    return trusted.select("lang", "t").mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def train(trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, n, gram, p, weight) of (lang, t): for each gram of n characters its discounted probability, null if it is
    only a context, and as a context of order n + 1 its back-off weight, null if it is none."""
    # a gram of n characters fills the lower 16 n bits
    counts = scratch.save(_count(trusted), "counts").withColumn("n", F.lit(ORDER))
    levels = [counts]
    for n in range(ORDER - 1, 0, -1):
        low = levels[-1].select("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("gram"))
        levels.append(low.groupBy("lang", "gram").agg(F.count("*").alias("c")).withColumn("n", F.lit(n)))
    all_ = levels[0]
    for x in levels[1:]:
        all_ = all_.unionByName(x)
    all_ = scratch.save(all_, "levels")
    ones = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in range(1, 5)]
    d = all_.groupBy("lang", "n").agg(*ones)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    raw = [F.lit(i) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)]
    # where counts of counts allow none, a usual discount
    d = d.select("lang", "n", *(F.when((x > 0) & (x < i), x).otherwise(F.lit(0.75)).alias(f"d{i}") for i, x in zip((1, 2, 3), raw)))
    disc = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    d = d.withColumnsRenamed({"lang": "dl", "n": "dn"})
    g = all_.join(F.broadcast(d), F.col("lang").eqNullSafe(F.col("dl")) & (F.col("n") == F.col("dn")))  # ORDER rows a language
    g = g.select("lang", "n", "gram", "c", disc.alias("d"), F.expr("shiftrightunsigned(gram, 16)").alias("ctx"))
    contexts = g.groupBy("lang", "n", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
    same = F.col("g.lang").eqNullSafe(F.col("x.lang")) & (F.col("g.n") == F.col("x.n")) & (F.col("g.ctx") == F.col("x.ctx"))
    p = g.alias("g").join(contexts.alias("x"), same).select("g.lang", "g.n", "gram", ((F.col("c") - F.col("d")) / F.col("total")).alias("p"))
    w = contexts.select("lang", (F.col("n") - 1).alias("n"), F.col("ctx").alias("gram"), "weight")
    both = p.withColumn("weight", F.lit(None).cast("double")).unionByName(w.withColumn("p", F.lit(None).cast("double")))
    return scratch.save(both.groupBy("lang", "n", "gram").agg(F.max("p").alias("p"), F.max("weight").alias("weight")), "model")


def _loss(grams: np.ndarray, look) -> np.ndarray:
    """-log p of each ORDER-gram's last character, from the lowest order up; look(n, grams) -> probabilities and back-off weights,
    NaN where there are none."""
    prob = np.full(len(grams), FLOOR)
    for n in range(1, ORDER + 1):
        own = grams & np.uint64((1 << 16 * n) - 1) if n < ORDER else grams
        p, _ = look(n, own)
        _, weight = look(n - 1, own >> np.uint64(16))
        prob = np.where(np.isnan(weight), prob, np.nan_to_num(p) + weight * prob)
    return -np.log(prob)


class Model:
    """One language's entries as sorted arrays."""

    def __init__(self, rows: dict[str, np.ndarray]):
        self.levels = []
        for n in range(ORDER + 1):
            at = np.flatnonzero(rows["n"] == n)
            g = rows["gram"][at].view(np.uint64)
            o = np.argsort(g)
            self.levels.append((g[o], rows["p"][at][o], rows["weight"][at][o]))

    def _look(self, n: int, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, p, w = self.levels[n]
        if not len(g):
            return np.full(len(gram), np.nan), np.full(len(gram), np.nan)
        at = np.minimum(np.searchsorted(g, gram), len(g) - 1)
        hit = g[at] == gram
        return np.where(hit, p[at], np.nan), np.where(hit, w[at], np.nan)

    def loss(self, grams: np.ndarray) -> np.ndarray:
        return _loss(grams, self._look)


class Shards:
    """A model in sorted files of the shared folder: the sorted grams of a block of documents are merged with those shards whose
    ranges they meet. A process keeps at most CACHE_BYTES of shards, so memory does not grow with the model."""

    def __init__(self, index: list[tuple[str, str, int, int, int]]):
        self.ranges: dict[tuple[str, int], list[tuple[str, int, int]]] = {}
        for file, lang, n, lo, hi in index:
            self.ranges.setdefault((lang, n), []).append((file, lo, hi))
        self.held: OrderedDict[str, tuple[int, dict]] = OrderedDict()

    def __contains__(self, lang: str) -> bool:
        return (lang, ORDER) in self.ranges

    def _shard(self, file: str) -> dict:
        if file not in self.held:
            files, path = fs.FileSystem.from_uri(file)
            with files.open_input_file(path) as f:
                t = pq.read_table(f)
            cols = {c: t.column(c).to_numpy() for c in ("gram", "p", "weight")}
            langs, n = t.column("lang").combine_chunks(), t.column("n").to_numpy()
            same = np.asarray(pc.equal(langs[1:], langs[:-1])) & (n[1:] == n[:-1]) if len(n) > 1 else np.zeros(0, bool)
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(n)]
            parts = {(langs[a].as_py(), int(n[a])): tuple(cols[c][a:b] for c in cols) for a, b in zip(cuts, cuts[1:]) if b > a}
            while self.held and sum(x[0] for x in self.held.values()) + 24 * len(n) > CACHE_BYTES:
                self.held.popitem(last=False)
            self.held[file] = (24 * len(n), parts)
        self.held.move_to_end(file)
        return self.held[file][1]

    def _look(self, lang: str, n: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want, back = np.unique(grams.view(np.int64), return_inverse=True)
        p, w = np.full(len(want), np.nan), np.full(len(want), np.nan)
        for file, lo, hi in self.ranges.get((lang, n), ()):
            a, b = np.searchsorted(want, lo), np.searchsorted(want, hi, "right")
            if a < b:
                g, gp, gw = self._shard(file)[lang, n]
                at = np.minimum(np.searchsorted(g, want[a:b]), len(g) - 1)
                hit = g[at] == want[a:b]
                p[a:b][hit], w[a:b][hit] = gp[at][hit], gw[at][hit]
        return p[back], w[back]

    def loss(self, lang: str, grams: np.ndarray) -> np.ndarray:
        return _loss(grams, lambda n, x: self._look(lang, n, x))


def shards(model: DataFrame, scratch: Scratch, entries: int) -> list[tuple[str, str, int, int, int]]:
    """Writes the model in files sorted by (lang, n, gram) and returns their ranges, a row for each file, language and order."""
    parts = max(1, -(-model.count() // entries))
    table = scratch.save(model.repartitionByRange(parts, "lang", "n", "gram").sortWithinPartitions("lang", "n", "gram"), "shards")
    ranges = table.groupBy(F.input_file_name().alias("file"), "lang", "n").agg(F.min("gram").alias("lo"), F.max("gram").alias("hi"))
    return [tuple(r) for r in ranges.orderBy("lang", "n", "lo").collect()]


def _score(docs: DataFrame, index: list[tuple], code: Column, text: str, out: str) -> DataFrame:
    """Adds a document's mean loss by character (null without a model of the language or without text) as `out`."""
    (code_name,) = fresh(docs, "language_code")
    src = docs.withColumn(code_name, code)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # a row for each file, language and order
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Shards(shared.value)
        for b, texts in _runs(batches, text):
            own = np.array(b.column(code_name).to_pylist(), dtype=object)
            loss: list[float | None] = [None] * len(texts)
            for x in sorted(set(own)):
                rows = [i for i in np.flatnonzero(own == x) if texts[i].strip()]
                if x not in model or not rows:
                    continue
                grams = [_grams(texts[i]) for i in rows]
                seen, at = np.unique(np.concatenate(grams), return_inverse=True)
                each = model.loss(x, seen)[at]
                begin = 0
                for i, g in zip(rows, grams):
                    loss[i] = round(float(each[begin : begin + len(g)].mean()), DIGITS)
                    begin += len(g)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], pa.array(loss, pa.float64())], names=[*fields.names, out])

    return src.mapInArrow(run, StructType([*fields.fields, StructField(out, DoubleType())]))


def _code(lang: Column) -> Column:
    """A name for each language; null is one of its own, apart from the empty one."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The documents with all their columns and __loss, __limit (mean loss, and the most that is accepted) and
    __accepted boolean. exp of the losses are perplexities.

    `labels`: (key, quality, toxic); trusted are keys of which every label says quality 1 and toxic 0. Null or blank
    texts, and languages without a trusted document, have no loss or no limit and are accepted. A null language is one
    of its own, as is an empty one. Rows are kept one for one, repeated ones included; texts of any length are read whole; equal
    losses are equal verdicts; empty documents give an empty table, empty labels accept all. The three added columns are the
    only names that must be free.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    ids = labels.groupBy(F.col(key).alias("tk")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).where("q = 1 AND x = 0 AND tk IS NOT NULL").select("tk")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    base = docs.select(F.col(key).alias("k"), _code(F.col(lang)).alias("lang"), F.col(text).cast("string").alias("t"))
    trusted = base.where(F.length(F.trim("t")) > 0).join(ids, F.col("k") == F.col("tk"), "left_semi")
    trusted = scratch.save(trusted.select("lang", "t", (F.pmod(F.xxhash64("t"), F.lit(HELD_OUT)) == 0).alias("held")), "trusted")
    index = shards(train(trusted.where("NOT held"), scratch), scratch, SHARD_ENTRIES)

    held = scratch.save(_score(trusted.where("held").select("lang", "t"), index, F.col("lang"), "t", "loss").where("loss IS NOT NULL").drop("t"), "held")
    limits = held.groupBy("lang").agg(F.percentile_approx("loss", F.lit(quantile), F.lit(10000)).alias("limit")).collect()  # a row a language
    scored = _score(docs, index, _code(F.col(lang)), text, "__loss")
    limit = F.lit(None).cast("double")
    if limits:
        limit = F.create_map(*(x for r in limits for x in (F.lit(r["lang"]), F.lit(r["limit"]))))[_code(F.col(lang))]
    out = scored.withColumn("__limit", limit)
    return out.withColumn("__accepted", F.coalesce(F.col("__loss") <= F.col("__limit"), F.lit(True)))
