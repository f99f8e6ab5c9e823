"""Interval algebra on rows (key..., s, e), half open, in any numeric unit.

Every operator takes key columns and shuffles once by them. `merge` takes a bucket length as well: intervals are then
merged by (key, bucket of s) first and the few results by key, which is the same set and spreads a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = Sequence[str]


def _islands(df: DataFrame, by: Sequence[Column | str], key: Key, gap: float) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.when(F.col("s") - reach <= gap, 0).otherwise(1))
    df = df.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*by, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*key, "s", "e")


def merge(df: DataFrame, key: Key, gap: float = 0, bucket: float | None = None) -> DataFrame:
    """(key, s, e): empty intervals dropped, those at most `gap` apart joined; touching ones are."""
    df = df.select(*key, "s", "e").where("e > s")
    if bucket is not None:
        df = _islands(df.withColumn("__bucket", F.floor(F.col("s") / bucket)), [*key, "__bucket"], key, gap)
    return _islands(df, list(key), key, gap)


def invert(cuts: DataFrame, bounds: DataFrame, key: Key) -> DataFrame:
    """(key, s, e): what the cuts leave of each key's [lo, hi); keys without cuts keep all. bounds: (key, lo, hi)."""
    inside = cuts.select(*key, "s", "e").join(bounds.select(*key, "lo", "hi"), list(key))
    inside = inside.select(*key, "lo", F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e")).where("e > s")
    ends = bounds.select(*key, "lo", F.col("hi").alias("s"), F.col("hi").alias("e"))
    order = Window.partitionBy(*key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    out = inside.unionByName(ends).withColumn("__from", F.greatest("lo", F.coalesce(F.max("e").over(order), F.col("lo"))))
    return out.where(F.col("s") > F.col("__from")).select(*key, F.col("__from").alias("s"), F.col("s").alias("e"))


def overlapping(a: DataFrame, b: DataFrame, key: Key, bin_: float | None = None) -> DataFrame:
    """Pairs with a.s < b.e and b.s < a.e; b's columns s, e become bs, be. bin_: compare only within time bins of that
    length, each pair in the first bin that both touch, so that a key with many intervals is spread."""
    b = b.withColumnsRenamed({"s": "bs", "e": "be"})
    if bin_ is None:
        return a.join(b, list(key)).where("s < be AND bs < e")
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_), F.floor(F.col(e) / bin_)))
    both = a.withColumn("__bin", bins("s", "e")).join(b.withColumn("__bin", bins("bs", "be")), [*key, "__bin"])
    return both.where((F.col("s") < F.col("be")) & (F.col("bs") < F.col("e")) & (F.col("__bin") == F.floor(F.greatest("s", "bs") / bin_))).drop("__bin")


def intersect(a: DataFrame, b: DataFrame, key: Key, bin_: float | None = None) -> DataFrame:
    both = overlapping(merge(a, key), merge(b, key), key, bin_)
    return both.select(*key, F.greatest("s", "bs").alias("s"), F.least("e", "be").alias("e"))


def subtract(keep: DataFrame, cuts: DataFrame, key: Key, min_len: float = 0) -> DataFrame:
    """What is longer than `min_len` of the merged keeps without the cuts."""
    bounds = merge(keep, key).withColumnsRenamed({"s": "lo", "e": "hi"})
    near = cuts.select(*key, "s", "e").join(bounds, list(key)).where("s < hi AND e > lo").drop("hi")
    left = invert(near.select(*key, "lo", "s", "e").withColumnRenamed("lo", "__k"), bounds.withColumn("__k", F.col("lo")), [*key, "__k"])
    return left.where(F.col("e") - F.col("s") > min_len).select(*key, "s", "e")


def total(df: DataFrame, key: Key) -> DataFrame:
    return merge(df, key).groupBy(*key).agg(F.sum(F.col("e") - F.col("s")).alias("total"))


def _reached(rows: DataFrame, items: DataFrame, key: Key, at: Column, since: Column, strict: bool, anti: bool) -> DataFrame:
    """Rows of which some item that begins at or before `at` (strict: before) ends after `since`: the farthest end of the items so
    far, by one window over both tables, so a key with n rows and m items costs n + m and not n x m."""
    carried = [c for c in rows.columns if c not in key]
    r = rows.select(*key, at.alias("__at"), F.lit(0 if strict else 2).alias("__kind"), F.struct(since.alias("since"), *(F.col(c) for c in carried)).alias("__row"), F.lit(None).cast(items.schema["e"].dataType).alias("__e"))
    i = items.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).select(*key, F.col("s").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(r.schema["__row"].dataType).alias("__row"), F.col("e").alias("__e"))
    so_far = F.max("__e").over(Window.partitionBy(*key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    both = r.unionByName(i).withColumn("__far", so_far).where("__kind <> 1")
    hit = F.coalesce(F.col("__far") > F.col("__row.since"), F.lit(False))
    out = both.where(~hit if anti else hit)
    return out.select(*(F.col(c) if c in key else F.col(f"__row.{c}") for c in rows.columns))


def containing(points: DataFrame, items: DataFrame, key: Key, t: str = "t", anti: bool = False) -> DataFrame:
    """Points in (or with `anti`, outside of) any interval [s, e)."""
    return _reached(points, items, key, F.col(t), F.col(t), False, anti)


def touching(a: DataFrame, b: DataFrame, key: Key, anti: bool = False) -> DataFrame:
    """Rows of a that overlap some row of b (with `anti`, none)."""
    return _reached(a, b, key, F.col("e"), F.col("s"), True, anti)


def snap_keep(keep: DataFrame, durations: DataFrame, key: Key, fps: float) -> DataFrame:
    """Kept ranges (seconds) grown out to whole frames and merged; the ends 0 and `duration` stay exact."""
    df = keep.join(durations.select(*key, "duration"), list(key))
    s = F.when(F.col("s") <= 1e-6, 0.0).otherwise(F.floor(F.col("s") * fps + 1e-6) / fps)
    e = F.when(F.col("e") >= F.col("duration") - 1e-6, F.col("duration")).otherwise(F.least(F.ceil(F.col("e") * fps - 1e-6) / fps, F.col("duration")))
    return merge(df.select(*key, s.alias("s"), e.alias("e")), key)


def split_protected(pieces: DataFrame, protect: DataFrame, key: Key, slack: float = 1e-3, flag: str = "phone") -> DataFrame:
    """(key, s, e, flags): pieces cut at the edges of protected ranges, whose parts get a flag. pieces: (key, s, e, flags).
    Protected ranges of a key must not overlap one another; `merge` them before."""
    p = pieces.withColumnsRenamed({"s": "ps", "e": "pe"})
    prot = protect.select(*key, "s", "e")
    part = p.join(prot, list(key)).where("s < pe AND e > ps")
    part = part.withColumns({"s": F.greatest("s", "ps"), "e": F.least("e", "pe")}).where(F.col("e") - F.col("s") >= slack)
    flagged = part.select(*key, "s", "e", F.array_append("flags", F.lit(flag)).alias("flags"))
    bounds = p.select(*key, F.col("ps").alias("lo"), F.col("pe").alias("hi"), F.col("ps").alias("__k"), "flags")
    rest = invert(part.select(*key, F.col("ps").alias("__k"), "s", "e"), bounds, [*key, "__k"])
    rest = rest.where(F.col("e") - F.col("s") > slack).join(bounds.select(*key, "__k", "flags"), [*key, "__k"])
    return flagged.unionByName(rest.select(*key, "s", "e", "flags"))


def split_at(pieces: DataFrame, points: DataFrame, key: Key, least: float, t: str = "t") -> DataFrame:
    """Pieces cut at the points that lie more than `least` inside of their edges; other columns are carried along."""
    pts = points.select(*key, F.col(t).alias("__t")).distinct()
    on = [F.col(f"p.{k}") == F.col(f"q.{k}") for k in key] + [F.col("__t") > F.col("p.s") + least, F.col("__t") < F.col("p.e") - least]
    rest = [c for c in pieces.columns if c not in (*key, "s", "e")]
    hit = pieces.alias("p").join(pts.alias("q"), on, "left")
    cut = hit.groupBy(*(F.col(f"p.{c}") for c in pieces.columns)).agg(F.array_sort(F.collect_set("__t")).alias("__cuts"))
    edges = F.concat(F.array("s"), "__cuts", F.array("e"))
    pair = F.transform(F.sequence(F.lit(0), F.size("__cuts")), lambda i: F.struct(F.get(edges, i).alias("s"), F.get(edges, i + 1).alias("e")))
    return cut.select(*key, *rest, F.explode(pair).alias("__p")).select(*key, *rest, "__p.s", "__p.e")


def apply_cuts(pieces: DataFrame, cuts: DataFrame, key: Key, least: float) -> DataFrame:
    """Pieces without the cuts; parts of at least `least` stay and carry the other columns along."""
    rest = [c for c in pieces.columns if c not in (*key, "s", "e")]
    bounds = pieces.select(*key, F.col("s").alias("lo"), F.col("e").alias("hi"), F.col("s").alias("__k"))
    near = cuts.select(*key, "s", "e").join(bounds, list(key)).where("s < hi AND e > lo").select(*key, "__k", "s", "e")
    left = invert(near, bounds, [*key, "__k"]).where(F.col("e") - F.col("s") >= least)
    return left.join(pieces.drop("e").withColumnRenamed("s", "__k"), [*key, "__k"]).select(*key, *rest, "s", "e")


def true_runs(df: DataFrame, key: Key, flag: Column, step: float, pad: float, least: float, lo: str = "lo", hi: str = "hi", t: str = "t") -> DataFrame:
    """Runs of true flags as ranges: half a step and a pad longer at both ends, clipped to [lo, hi], merged, no shorter
    than `least`. df: (key, t, lo, hi, ...)."""
    order = Window.partitionBy(*key).orderBy(t)
    df = df.withColumn("__on", F.when(flag, 1).otherwise(0))
    df = df.withColumn("__run", F.sum(1 - F.col("__on")).over(order)).where("__on = 1")
    runs = df.groupBy(*key, "__run").agg(F.min(t).alias("a"), F.max(t).alias("b"), F.max(lo).alias("l"), F.min(hi).alias("h"))
    runs = runs.select(*key, F.greatest("l", F.col("a") - step / 2 - pad).alias("s"), F.least("h", F.col("b") + step / 2 + pad).alias("e"))
    return merge(runs, key).where(F.col("e") - F.col("s") >= least)


def clean_ranges(df: DataFrame, key: Key, luma: str, lo: float, hi: float, jump: float, grow: int, step: float, least: float, i: str = "i") -> DataFrame:
    """Stretches without bad frames: too dark, too bright, or a jump of the luma, and `grow` frames around them."""
    order = Window.partitionBy(*key).orderBy(i)
    bad = (F.col(luma) < lo) | (F.col(luma) > hi) | (F.abs(F.col(luma) - F.lag(luma, 1).over(order)) > jump)
    df = df.withColumn("__bad", F.coalesce(bad, F.lit(False)).cast("int"))
    df = df.withColumn("__bad", F.max("__bad").over(order.rowsBetween(-grow, grow)))
    df = df.withColumn("__run", F.sum("__bad").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__bad = 0")
    out = df.groupBy(*key, "__run").agg(F.min(i).alias("a"), F.max(i).alias("b"))
    out = out.select(*key, (F.col("a") * step).alias("s"), ((F.col("b") + 1) * step).alias("e"))
    return out.where(F.col("e") - F.col("s") >= least)


def sample_times(df: DataFrame, key: Key, step: float) -> DataFrame:
    """Midpoints of max(1, floor(length / step)) equal parts of each range."""
    n = F.greatest(F.lit(1), F.floor((F.col("e") - F.col("s")) / step).cast("int"))
    df = df.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return df.select(*key, "s", "e", (F.col("s") + (F.col("__i") + 0.5) * (F.col("e") - F.col("s")) / F.col("__n")).alias("t"))
