"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A document is contaminated by an item if some 13 consecutive words of the item stand in it in order with at most 2 of
them substituted. Shorter items must stand whole, with the same share of substitutions: one of 7 to 12 words, none of fewer. Masks pick 6 of up to 11 neighbouring words and ignore the others; MASKS leave, for every placing of 2
substitutions in 13 words, at least one mask position untouched (a test goes through all of them); of a shorter item, its first
or its last half is untouched. Hashes under the masks are joined; around each hit the words are compared one by one.

Documents are read once and not shuffled while the item side is small enough to broadcast (its words are counted first).
Beyond that, seeds and items are joined by shuffles that carry ids and positions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_hashes

WINDOW, SUBSTITUTIONS = 13, 2
MASKS = ((0, 1, 2, 5, 9, 10), (0, 1, 3, 4, 5, 6))
#: Words of all items up to which their seeds are broadcast (about 100 bytes a word and mask).
BROADCAST_WORDS = 250_000


def _seed(h: Column, at: Column, masks: Sequence[Sequence[int]], m: Column) -> Column:
    """Hash of the words at `at` under mask number m."""
    cases = [F.xxhash64(F.lit(i), *(F.get(h, at + o) for o in mask)) for i, mask in enumerate(masks)]
    return reduce(lambda rest, c: F.when(m == c[0], c[1]).otherwise(rest), list(enumerate(cases))[:-1][::-1], cases[-1])


def _allowed(words):
    """Substitutions in that many words, a number or a column of numbers."""
    return words * SUBSTITUTIONS / WINDOW


def _half(n: int) -> int:
    """Words of a seed of an item of n < WINDOW words: half of it, or all where nothing may be substituted."""
    return n if int(_allowed(n)) == 0 else n // 2


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", broadcast_words: int = BROADCAST_WORDS
) -> DataFrame:
    """(key, text_hash, item key, matched long, item_words long): a row for each contaminated text and item.

    matched: equal words at the best alignment that holds such a window. Null, empty and wordless texts and items match
    nothing. text_hash (xxhash64 of the text) tells apart rows that share a key; repeated rows give one row. Null keys and null
    item keys are kept. Texts of any length are read whole, a row at a time; empty tables give an empty one. Other columns are
    dropped, so their names cannot clash.
    """
    bench = items.select(F.col(item_key).alias("item"), word_hashes(F.col(item_text)).alias("ih"))
    bench = bench.withColumn("n", F.size("ih")).where("n > 0").distinct()
    lengths = {r.n for r in bench.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()}  # at most 13 numbers
    halves = sorted({_half(n) for n in lengths if n < WINDOW})
    masks = [*(MASKS if WINDOW in lengths else ()), *(tuple(range(n)) for n in halves)]
    if not masks:
        masks = [(0,)]
    total = bench.agg(F.sum("n")).first()[0] or 0
    bench = bench.withColumn("item_no", F.xxhash64("item", "ih"))
    pos = bench.select("item_no", "n", "ih", F.explode(F.sequence(F.lit(0), F.col("n") * len(masks) - 1)).alias("i"))
    pos = pos.withColumn("ip", F.expr(f"i div {len(masks)}").cast("int")).withColumn("m", F.col("i") % len(masks))
    reach = F.array(*(F.lit(max(m)) for m in masks))
    spaced = len(masks) - len(halves)
    wide = (F.col("n") >= WINDOW) & (F.col("m") < spaced) & (F.col("ip") + F.get(reach, F.col("m")) < F.col("n"))
    use = wide
    for n in sorted(lengths - {WINDOW}):
        h = _half(n)
        use = use | ((F.col("n") == n) & (F.col("m") == spaced + halves.index(h)) & F.col("ip").isin(0, n - h))
    seeds = pos.where(use).select(_seed(F.col("ih"), F.col("ip"), masks, F.col("m")).alias("seed"), "item_no", "ip")
    bench = bench.select("item_no", "item", "ih", F.col("n").alias("item_words"))

    base = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), word_hashes(F.col(text)).alias("h"))
    long_enough = base.where(F.size("h") > 0)
    at = long_enough.select("k", "text_hash", "h", F.explode(F.sequence(F.lit(0), F.size("h") * len(masks) - 1)).alias("i"))
    at = at.withColumn("p", F.expr(f"i div {len(masks)}").cast("int"))
    at = at.withColumn("seed", _seed(F.col("h"), F.col("p"), masks, F.col("i") % len(masks)))
    if total <= broadcast_words:
        hits = at.select("k", "text_hash", "h", "p", "seed").join(F.broadcast(seeds), "seed")
        hits = hits.join(F.broadcast(bench), "item_no")
    else:
        found = at.select("k", "text_hash", "p", "seed").join(seeds, "seed").select("k", "text_hash", "p", "item_no", "ip").distinct()
        same = F.col("x.k").eqNullSafe(F.col("y.k")) & (F.col("x.text_hash") == F.col("y.text_hash"))
        full = found.alias("x").join(long_enough.alias("y"), same).select("x.k", "x.text_hash", "h", "p", "item_no", "ip")
        hits = full.join(bench, "item_no")

    # equal words of the whole alignment, as 0 and 1 by the item's position; words outside the document differ
    hits = hits.withColumn("shift", F.col("p") - F.col("ip"))
    own = lambda j: F.when((j + F.col("shift") >= 0) & (F.get("ih", j) == F.get("h", j + F.col("shift"))), 1).otherwise(0)
    hits = hits.withColumn("same", F.transform(F.sequence(F.lit(0), F.col("item_words") - 1), own))
    size = F.least(F.lit(WINDOW), F.col("item_words"))
    need = size - F.floor(_allowed(size))
    # a window that fits holds an untouched seed, so the windows over this seed are enough
    first = F.greatest(F.lit(0), F.col("ip") - WINDOW + 1)
    last = F.least(F.col("ip"), F.col("item_words") - size)
    window = lambda s: F.aggregate(F.slice("same", s + 1, size), F.lit(0), lambda a, x: a + x) >= need
    good = hits.where(F.exists(F.sequence(F.least(first, last), last), window))
    good = good.select("k", "text_hash", "item", "item_words", F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("matched"))
    out = good.groupBy("k", "text_hash", "item", "item_words").agg(F.max("matched").cast("long").alias("matched"))
    return out.select(F.col("k").alias(key), "text_hash", F.col("item").alias(item_key), "matched", F.col("item_words").cast("long").alias("item_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    bad = contaminated(docs, items, key, text).select(F.col(key).alias("bad_key"), F.col("text_hash").alias("bad_hash")).distinct()
    same = docs[key].eqNullSafe(bad["bad_key"]) & (F.xxhash64(docs[text].cast("string")) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti")


#: The same by plain counting, for tests and the SQL check: all words against all words.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM benchmark),
     dw AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d),
     bw AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM b),
     m AS (SELECT doc_id, item_id, n, dw.p - bw.p AS shift, bw.p AS p FROM dw JOIN bw ON dw.w = bw.w),
     c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS near,
                  count(*) OVER (PARTITION BY doc_id, item_id, shift) AS matched FROM m)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(n AS BIGINT) AS item_words
FROM c WHERE near >= least(n, {WINDOW}) - least(n, {WINDOW}) * {SUBSTITUTIONS} // {WINDOW}
GROUP BY doc_id, item_id, n
"""
