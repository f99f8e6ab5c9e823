"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle is thrown into one of t bins by the i-th hash and the least value of the earliest round
fills a bin; after t rounds, round t + b throws every shingle into bin b, so every coordinate fills. Coordinates agree
with probability equal to the Jaccard similarity, and their number of agreements is concentrated at least as well as
that of t independent ones.

Candidates share all coordinates of one band; equal sets are one class from the start and only classes are compared.
Links are confirmed on the full shingle sets. Within a bucket each class meets the least one (a star). Where stars leave
different components in a bucket, each class meets the one with the fewest shingles that are its own alone, and at last
those with which it shares one of its rarest shingles: by the prefix principle two linked sets always do, while texts that have only a
frequent core in common never meet. Pairs are compared only where an exact bound allows a link: folds of 2,048 bits never differ
in more bits than the sets differ in shingles. So a group of n near copies costs about n comparisons, and no link between
components is missed. Components, buckets and texts live in tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

BANDS, ROWS = 40, 5
#: Two sets of similarity 0.8 or more differ in more of the 200 one-bit marks than this with probability under 1e-10.
MARK_SIGMAS = 8
FOLD_BITS = 2048
FOLDS = [f"f{i}" for i in range(FOLD_BITS // 64)]
BRIEF = 8  # words of a fold of 512 bits: folds of folds keep the bound
CACHE_WORDS = 500_000
_M = (1 << 64) - 1


def words_of(text: str) -> list[bytes]:
    """Lower-cases A-Z and splits at runs of space and bytes 9 to 13."""
    return text.encode().lower().split()


def shingle_set(text: str, width: int) -> frozenset:
    """Distinct runs of `width` words; of fewer words the whole sequence; empty without words."""
    w = words_of(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[i:] for i in range(width))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Shingle hashes, fingerprints, sketches, bands and marks of texts."""

    def __init__(self, width: int, bands: int, rows: int):
        self.width, self.bands, self.rows, self.t = width, bands, rows, bands * rows
        self.words: dict[bytes, int] = {}
        self.place = _mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.seeds = _mix(np.arange(1, 2 * self.t + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.fold = _mix(np.arange(7, rows + 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def _hash(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: str) -> np.ndarray:
        w = words_of(text)
        if not w:
            return np.zeros(0, np.uint64)
        h, k = self._hash(w), min(self.width, len(w))
        n = len(h) - k + 1
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total += _mix(h[i : i + n] + self.place[i]) * self.place[i]
        return np.unique(_mix(total))

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """t coordinates; each holds the round and 40 bits of the hash of the shingle that won it."""
        t, n = self.t, len(shingles)
        out = np.full(t, _M, np.uint64)
        done = 0
        while done < t:
            rounds = min(t - done, max(1, int(1.2 * t * np.log(t) / n)))
            h = _mix(shingles[None, :] + self.seeds[done : done + rounds, None])
            value = (h & np.uint64((1 << 40) - 1)) | (np.arange(done, done + rounds, dtype=np.uint64) << np.uint64(40))[:, None]
            np.minimum.at(out, (((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)).ravel().astype(np.intp), value.ravel())
            done += rounds
            if (out != _M).all():
                return out
        for b in np.flatnonzero(out == _M):
            h = _mix(shingles + self.seeds[t + b])
            out[b] = (h & np.uint64((1 << 40) - 1)).min() | np.uint64((t + b) << 40)
        return out

    def describe(self, text: str) -> tuple[int, bytes | None, bytes | None, np.ndarray]:
        """Size and fingerprint of the set, one bit a coordinate, a hash a band."""
        s = self.shingles(text)
        if not len(s):
            return 0, None, None, np.zeros(0, np.int64)
        c = self.sketch(s)
        band = (_mix(c.reshape(self.bands, self.rows)) * self.fold).sum(axis=1, dtype=np.uint64) + self.seeds[: self.bands]
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), np.packbits((_mix(c) >> np.uint64(63)).astype(bool)).tobytes(), _mix(band).view(np.int64)


_SKETCHERS: dict[tuple, Sketcher] = {}


def _sketches(src: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(k, n, fp, marks m0..m3, bands) of (k, t); one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _SKETCHERS.setdefault((width, bands, rows), Sketcher(width, bands, rows))
        for batch in batches:
            n, fp, marks, hashes, ends = [], [], [], [], [0]
            for t in batch.column(1):
                size, print_, mark, band = own.describe(t.as_py() or "")
                n.append(size)
                fp.append(print_)
                marks.append((mark or b"").ljust(32, b"\0")[:32])
                hashes.append(band)
                ends.append(ends[-1] + len(band))
            longs = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 4)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), *(pa.array(longs[:, i]) for i in range(4)), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "n", "fp", "m0", "m1", "m2", "m3", "bands"])

    kind = src.schema["k"].dataType.simpleString()
    return src.mapInArrow(run, f"k {kind}, n long, fp binary, m0 long, m1 long, m2 long, m3 long, bands array<long>")


def _texts(src: DataFrame, wanted: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(node, t) for the nodes in `wanted` (k, node, fp); among rows with equal keys the fingerprint decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _SKETCHERS.setdefault((width, bands, rows), Sketcher(width, bands, rows))
        for b in batches:
            keep = [xxhash.xxh3_128_digest(own.shingles(t.as_py() or "").tobytes()) == fp.as_py() for fp, t in zip(b.column(1), b.column(2))]
            yield b.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    return src.join(wanted.withColumnRenamed("k", "wk"), F.col("k").eqNullSafe(F.col("wk"))).select("node", "fp", "t").mapInArrow(run, "node long, t string")


def _folds(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(node, f0, f1, ...): each shingle flips one of FOLD_BITS bits. Where two folds differ the sets differ, so the
    number of such bits is never more than the size of the sets' symmetric difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _SKETCHERS.setdefault((width, bands, rows), Sketcher(width, bands, rows))
        for batch in batches:
            flips = [np.bincount(own.shingles(t.as_py()) % np.uint64(FOLD_BITS), minlength=FOLD_BITS) & 1 for t in batch.column(1)]
            longs = np.packbits(np.array(flips, np.uint8).reshape(-1, FOLD_BITS), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(len(FOLDS)))], names=["node", *FOLDS])

    return texts.select("node", "t").mapInArrow(run, "node long, " + ", ".join(f"{f} long" for f in FOLDS))


def _shingle_rows(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(node, shingle): a row for each shingle hash of (node, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = _SKETCHERS.setdefault((width, bands, rows), Sketcher(width, bands, rows))
        for batch in batches:
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = sketcher.shingles(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(s.view(np.int64))], names=["node", "shingle"])

    return texts.select("node", "t").mapInArrow(run, "node long, shingle long")


def _prefixes(each: DataFrame, often: DataFrame, own: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """(shingle, node, short, after): of each set in order of rarity as many shingles as a set must share one of with any set that it can be
    linked to. Of two linked sets the smaller one has it among its `short` ones: it shares 2 num / (num + den) of its own, the
    larger one num / den. Shingles that are a set's own come first and lead nowhere, so only the others are rows. after: how many of the set's shingles follow."""
    up = lambda a, b: F.floor((a + b - 1) / b)
    shared = each.join(often, "shingle")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("c", "shingle"))
    at = shared.withColumn("rank", rank).join(own, "node").join(sizes, "node").withColumn("at", F.col("rank") + F.col("own"))
    long_, short = (F.col("n") - up(F.col("n") * p, F.lit(q)) + 1 for p, q in ((num, den), (2 * num, num + den)))
    return at.where(F.col("at") <= long_).select("shingle", "node", (F.col("at") <= short).alias("short"), (F.col("n") - F.col("at")).alias("after"))


def _verify(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have den * |A and B| >= num * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, frozenset()
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column(1), batch.column(2), batch.column(3)):
                if b.as_py() != last:
                    last, held = b.as_py(), shingle_set(tb.as_py(), width)
                own = shingle_set(ta.as_py(), width)
                both = len(own & held)
                keep.append(den * both >= num * (len(own) + len(held) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of the links (a, b): comp is the least node that it is connected to.

    Hash-min with pointer jumping: each pass takes the least label among the neighbours and then that label's own label,
    so long chains close in a logarithmic number of passes. Labels are a table after each pass; only a count reaches the
    driver.
    """
    both = links.select("a", "b").where("a <> b")
    edges = scratch.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("m"))
        jump = labels.select(F.col("node").alias("m"), F.col("comp").alias("far"))
        new = scratch.save(step.join(jump, "m").select("node", "old", F.least("m", "far").alias("comp")), "labels")
        scratch.drop(labels)
        moved = new.where("comp <> old").limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            return labels


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5), bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(key, n_shingles long, component_id, kept boolean, first boolean): a row for each input row.

    Sets are linked at similarity num/den or more (Jaccard, of distinct runs of `width` lower-cased words). A pair right
    at 4/5 escapes all bands with probability (1 - 0.8^rows)^bands, about 1e-7 here, and less the more alike it is.

    component_id is the least key reachable over links, itself included. Texts without words (null, empty, blank) have
    no shingles and are linked with nothing. kept: key = component_id. Rows that repeat a key are rows of their own;
    `first` holds for exactly one row of each component (the least key, then the least row), and for every row without
    words. Null keys are rows too: a component of null keys has a null id. Other columns are dropped, so their names
    cannot clash; an empty table gives an empty one.
    """
    num, den = similarity
    scratch = Scratch(df.sparkSession, "neardup")
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    docs = scratch.save(_sketches(src, width, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")

    # classes of equal sets; a class is named by its least row
    least = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "row"))
    classes = docs.where("n > 0").groupBy("fp").agg(F.min("row").alias("node"), least.alias("low"))
    classes = scratch.save(classes, "classes")
    reps = docs.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi").withColumnRenamed("row", "node")
    nodes = scratch.save(reps.select("node", "k", "fp", "n", "m0", "m1", "m2", "m3", "bands"), "nodes")

    band = nodes.select("node", F.explode("bands").alias("band"))
    leads = band.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("size")).where("size > 1")
    buckets = scratch.save(band.join(leads.select("band", "lead"), "band"), "buckets")

    size, marks = ["n"], [f"m{i}" for i in range(4)]
    t = bands * rows
    wrong = (1 - num / den) / 2
    most = int(t * wrong + MARK_SIGMAS * (t * wrong * (1 - wrong)) ** 0.5)
    facts = nodes.select("node", *size, *marks)

    def close(x: str, y: str):
        """Could two classes be linked, by their sizes and marks?"""
        differ = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in marks))
        return (F.least(f"{x}.n", f"{y}.n") * den >= F.greatest(f"{x}.n", f"{y}.n") * num) & (differ <= most)

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = facts.alias("x"), facts.alias("y")
        return pairs.join(a, F.col("a") == F.col("x.node")).join(b, F.col("b") == F.col("y.node")).where(close("x", "y")).select("a", "b")

    wanted = buckets.select("node").distinct()
    texts = scratch.save(_texts(src, nodes.select("k", "node", "fp").join(wanted, "node", "left_semi"), width, bands, rows), "texts")

    star = buckets.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    tried = scratch.save(likely(star.groupBy("a").agg(F.min("b").alias("b"))), "pairs")
    links = scratch.save(_verify(tried, texts, width, num, den), "links")
    labels = components(links, scratch)

    def labelled(pairs: DataFrame) -> DataFrame:
        """Adds the components ca, cb of both ends."""
        for end in ("a", "b"):
            own = labels.select(F.col("node").alias(end), F.col("comp").alias("c" + end))
            pairs = pairs.join(own, end, "left").withColumn("c" + end, F.coalesce("c" + end, end))
        return pairs

    def extend(more: DataFrame, name: str) -> None:
        """Verifies pairs between components and joins what they link."""
        nonlocal tried, links, labels
        new = scratch.save(likely(more).join(tried, ["a", "b"], "left_anti"), "pairs" + name)
        found = scratch.save(_verify(new, texts, width, num, den), "links" + name)
        tried, links = tried.unionByName(new), links.unionByName(found)
        if found.limit(1).count():
            labels = components(links, scratch)

    extend(labelled(star.distinct()).where("ca <> cb").select("a", "b"), "-stars")

    # what stars have left apart: buckets of several components
    def apart() -> DataFrame:
        inside = labels.select(F.col("node").alias("in"), F.col("comp").alias("c"))
        members = buckets.join(inside, F.col("node") == F.col("in"), "left").withColumn("c", F.coalesce("c", "node")).drop("in")
        mixed = members.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band")
        return members.join(mixed, "band", "left_semi")

    # for what is left: exact lower bounds on how much two sets differ, and how much of a set is its own
    members = scratch.save(apart(), "apart")
    left = texts.join(members.select("node").distinct(), "node", "left_semi")
    folds = scratch.save(_folds(left, width, bands, rows), "folds")
    facts = facts.join(folds, "node")

    def possible(x: str, y: str):
        """Could two classes be linked, by their folds as well?"""
        bits = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{x}.{f}").bitwiseXOR(F.col(f"{y}.{f}"))) for f in FOLDS))
        return close(x, y) & (bits * (den + num) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (den - num))

    # a second star around the class that has the least of its own
    each = scratch.save(_shingle_rows(left, width, bands, rows), "shingles")
    often = each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    often = scratch.save(often, "often")
    alone = often.where("c = 1").groupBy("node").agg(F.count("*").alias("own"))
    own = scratch.save(left.select("node").join(alone, "node", "left").select("node", F.coalesce("own", F.lit(0).cast("long")).alias("own")), "own")
    best = members.join(own, "node").join(nodes.select("node", "n"), "node").groupBy("band").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("part"), "node")).alias("best"))
    hub = members.join(best, "band").select(F.col("node").alias("a"), F.col("best.node").alias("b")).where("a <> b")
    a, b = facts.alias("x"), facts.alias("y")
    hub = labelled(hub.distinct()).where("ca <> cb").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    extend(hub.join(a, F.col("a") == F.col("x.node")).join(b, F.col("b") == F.col("y.node")).where(possible("x", "y")).select("a", "b"), "-hubs")

    # whatever links are left share a rare shingle: buckets by those, of several components, however large the band was
    scratch.drop(members)
    members = scratch.save(apart().select("node", "c").distinct().join(facts, "node"), "apart")
    brief = [reduce(lambda p, q: p.bitwiseXOR(q), (F.col(f) for f in FOLDS[i::BRIEF])).alias(f"b{i}") for i in range(BRIEF)]
    inside = members.select("node", F.col("c").alias("comp"), "n", *marks, *brief)
    rare = _prefixes(each.join(inside.select("node"), "node", "left_semi"), often.where("c > 1").select("shingle", "c"), own, nodes.select("node", "n"), num, den)
    rare = scratch.save(rare.join(inside.select("node", "comp"), "node"), "rare")
    mixed = rare.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("short").alias("any")).where("lo <> hi AND any").select("shingle")
    rare = rare.join(mixed, "shingle", "left_semi").join(inside.drop("comp"), "node")
    x, y = rare.alias("p"), rare.where("short").alias("q")
    # the bounds are part of the join, on folds of a quarter of the bits; what is left meets the whole folds below. At the first
    # shingle that linked sets share, they share no more than it and what follows in either
    bits = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"p.b{i}").bitwiseXOR(F.col(f"q.b{i}"))) for i in range(BRIEF)))
    follow = (F.least("p.after", "q.after") + 1) * (den + num) >= (F.col("p.n") + F.col("q.n")) * num
    near = follow & close("p", "q") & (bits * (den + num) <= (F.col("p.n") + F.col("q.n")) * (den - num))
    met = x.join(y, (F.col("p.shingle") == F.col("q.shingle")) & (F.col("p.comp") != F.col("q.comp")) & (F.col("p.n") >= F.col("q.n")) & near)
    met = met.select(F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b"))
    a, b = facts.alias("x"), facts.alias("y")
    extend(met.distinct().join(a, F.col("a") == F.col("x.node")).join(b, F.col("b") == F.col("y.node")).where(possible("x", "y")).select("a", "b"), "-rest")
    scratch.drop(each, often, rare)
    scratch.drop(texts, buckets, members)

    named = classes.join(labels, "node", "left").select("fp", "low", F.coalesce("comp", "node").alias("comp"))
    # tables in between, so that each join has two exchanges of its own and a hot component or class can be split
    low = scratch.save(named.groupBy("comp").agg(F.min("low").alias("first_of")), "least")
    named = scratch.save(named.join(low, "comp").select("fp", "first_of"), "named")
    out = docs.select("k", "n", "fp", "row").join(named, "fp", "left")
    alone = F.col("n") == 0
    id_ = F.when(alone, F.col("k")).otherwise(F.col("first_of.k"))
    return out.select(
        F.col("k").alias(key),
        F.col("n").alias("n_shingles"),
        id_.alias("component_id"),
        F.col("k").eqNullSafe(id_).alias("kept"),
        (alone | (F.col("row") == F.col("first_of.row"))).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents, with all their columns, of which one stays for each component; texts without words all stay.

    Among rows that repeat a key, those with a text that stays are kept once.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    row, sk, sh = fresh(docs, "row_of", "kept_key", "kept_hash")
    rows = docs.withColumn(row, F.struct(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("hash")))
    stay = scratch.save(near_duplicates(rows, row, text, width, similarity).where("first").select(row), "stay").distinct()
    stay = stay.select(F.col(f"{row}.key").alias(sk), F.col(f"{row}.hash").alias(sh))
    kept = rows.join(stay, F.col(f"{row}.key").eqNullSafe(F.col(sk)) & (F.col(f"{row}.hash") == F.col(sh)), "left_semi")
    twice = rows.groupBy(row).count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([key, text]) if twice else kept).drop(row)
