"""Operators on frame series (key..., i, value): i is a frame number from 0 without gaps, FPS frames a second."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge, touching

Key = Sequence[str]
FPS, FLOOR_DB = 50, -28.0
QUIET_FRAMES = 8


def energy_db(samples: DataFrame, key: Key, hop: int, n: str = "n", x: str = "x") -> DataFrame:
    """(key, i, db): RMS level of each whole frame of `hop` samples, less the median of the key's louder half."""
    fr = samples.groupBy(*key, F.floor(F.col(n) / hop).alias("i")).agg(F.count("*").alias("c"), F.avg(F.col(x) * F.col(x)).alias("ms")).where(F.col("c") == hop)
    fr = fr.select(*key, "i", (20 * F.log10(F.sqrt("ms") + 1e-9)).alias("raw"))
    return louder_half(fr, key, "raw", "db").select(*key, "i", "db")


def louder_half(df: DataFrame, key: Key, value: str, out: str) -> DataFrame:
    """Adds value less the median of the upper half of the key's values, sorted[n // 2:]."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(value))
    n = F.count("*").over(Window.partitionBy(*key))
    half = df.withColumn("__up", rank > F.floor(n / 2)).where("__up").groupBy(*key).agg(F.median(value).alias("__m"))
    return df.join(half, list(key)).withColumn(out, F.col(value) - F.col("__m")).drop("__m")


def smooth3(df: DataFrame, key: Key, value: str, out: str, i: str = "i") -> DataFrame:
    """Sum of three neighbours by 3; beyond the ends counts as 0."""
    order = Window.partitionBy(*key).orderBy(i).rowsBetween(-1, 1)
    return df.withColumn(out, F.sum(value).over(order) / 3)


def threshold(df: DataFrame, key: Key, value: str, out: str, frac: float = 0.35, floor: float | None = FLOOR_DB, half: int = 100, i: str = "i") -> DataFrame:
    """p15 + frac * (p85 - p15) of the frames [i - half, i + half), by linear interpolation, no lower than `floor`."""
    order = Window.partitionBy(*key).orderBy(i).rowsBetween(-half, half - 1)
    near = _quantiles(df.withColumn("__near", F.collect_list(value).over(order)), "__near", {"__low": 0.15, "__high": 0.85})
    t = F.col("__low") + frac * (F.col("__high") - F.col("__low"))
    return near.withColumn(out, F.greatest(t, F.lit(floor)) if floor is not None else t).drop("__low", "__high")


def _quantiles(df: DataFrame, values: str, ps: dict[str, float]) -> DataFrame:
    """Replaces an array of values by columns of its quantiles, by linear interpolation: lo (1 - d) + hi d, the first product fused
    with the sum as in SQL's quantile_cont. Levels meet values that lie right at them, so the last bit counts; `percentile` rounds
    otherwise. The product's rest comes from halves of 26 bits. A step a projection, so that none is worked out twice."""
    half = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    steps = [
        lambda c: {"at": (F.size(values) - 1) * F.lit(c.p)},
        lambda c: {"a": F.get(values, F.floor(c.at).cast("int")), "z": F.get(values, F.ceil(c.at).cast("int")), "d": c.at - F.floor(c.at)},
        lambda c: {"b": 1 - c.d, "c": c.z * c.d},
        lambda c: {"m": c.a * c.b, "ah": half(c.a), "bh": half(c.b)},
        lambda c: {"s": c.m + c.c, "al": c.a - c.ah, "bl": c.b - c.bh},
        lambda c: {"e": ((c.ah * c.bh - c.m) + c.ah * c.bl + c.al * c.bh) + c.al * c.bl, "g": c.s - c.m},
        lambda c: {"t": (c.m - (c.s - c.g)) + (c.c - c.g)},
        lambda c: {"": F.when(c.d == 0, c.a).otherwise(c.s + (c.t + c.e))},
    ]
    kept = [c for c in df.columns if c != values]
    df = df.withColumn(values, F.sort_array(values))
    for step in steps:
        new = {}
        for name, p in ps.items():
            new |= {name + k: x for k, x in step(_Parts(name, p)).items()}
        df = df.withColumns(new)
    return df.select(*kept, *ps)


class _Parts:
    """The columns of one quantile's steps, by name."""

    def __init__(self, name: str, p: float):
        self.name, self.p = name, p

    def __getattr__(self, part: str) -> Column:
        return F.col(self.name + part)


def median_smooth(df: DataFrame, key: Key, value: str, out: str, k: int = 5, i: str = "i") -> DataFrame:
    order = Window.partitionBy(*key).orderBy(i).rowsBetween(-(k // 2), k // 2)
    return df.withColumn(out, F.percentile(value, 0.5).over(order))


def loud_run(ranges: DataFrame, frames: DataFrame, key: Key, need: int = 12, edge: int = 3, middle: Column | None = None) -> DataFrame:
    """Adds loud: at least `need` frames of [x + edge, y - edge) stand above the level th of the range's middle frame.
    ranges: (key, x, y) in frames, distinct; frames: (key, i, v, th), th as `threshold` with frac 0.5 gives it. middle: another
    frame than floor((x + y) / 2)."""
    mid = frames.select(*key, F.col("i").alias("__m"), F.col("th").alias("__th"))
    r = ranges.withColumn("__m", F.floor((F.col("x") + F.col("y")) / 2) if middle is None else middle).join(mid, [*key, "__m"], "left")
    near = _with_frames(r, frames, key, F.col("x") + edge, F.col("y") - edge)
    return near.groupBy(*ranges.columns).agg((F.count(F.when(F.col("v") > F.col("__th"), 1)) >= need).alias("loud"))


def _with_frames(ranges: DataFrame, frames: DataFrame, key: Key, first: Column, end: Column) -> DataFrame:
    """Each range once a frame number of [first, end), with __i and the frame's v; v is null where there is no such frame, and a
    range without frame numbers keeps one row. An equi-join on key and frame, so that a key with many ranges is spread."""
    numbers = F.when(end > first, F.sequence(first, end - 1))
    f = frames.select(*key, F.col("i").cast("long").alias("__i"), "v")
    return ranges.withColumn("__i", F.explode_outer(numbers.cast("array<bigint>"))).join(f, [*key, "__i"], "left")


def scan(marks: DataFrame, frames: DataFrame, key: Key, forward: bool = True, quiet: int = QUIET_FRAMES) -> DataFrame:
    """Adds edge: where sound ends (forward) or begins (backward) near a mark.

    marks: (key, mark, start, limit) in frames; the scan goes from `start` towards `limit` (not included) and ends after
    `quiet` frames in a row that are not above th. forward: one past the last loud frame, or start + 1 without any;
    backward: the first loud frame, or start. frames: (key, i, v, th). The level is that of the mark's frame; a mark without
    a frame finds nothing loud. Marks are distinct rows and may have more columns."""
    level = frames.select(*key, F.col("i").alias("mark"), F.col("th").alias("__th"))
    m = marks.join(level, [*key, "mark"], "left")
    first, end = (F.col("start"), F.col("limit")) if forward else (F.col("limit") + 1, F.col("start") + 1)
    near = _with_frames(m, frames, key, first, end).withColumn("__loud", (F.col("v") > F.col("__th")).cast("int"))
    step = Window.partitionBy(*marks.columns).orderBy(F.col("__i") if forward else F.col("__i").desc())
    quiet_run = F.sum(1 - F.col("__loud")).over(step.rowsBetween(1 - quiet, 0))
    seen = F.count("v").over(step.rowsBetween(1 - quiet, 0))  # numbers beyond the last frame are none
    near = near.withColumn("__stop", ((quiet_run == quiet) & (seen == quiet)).cast("int"))
    near = near.withColumn("__over", F.coalesce(F.max("__stop").over(step.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    loud = F.when((F.col("__loud") == 1) & (F.col("__over") == 0), F.col("__i"))
    found = F.max(loud) if forward else F.min(loud)
    edge = F.coalesce(found, F.col("start")) + (1 if forward else 0)
    return near.groupBy(*marks.columns).agg(edge.alias("edge"))


def sound(frames: DataFrame, key: Key, value: str = "db", half: int = 100, floor: float | None = FLOOR_DB) -> DataFrame:
    """(key, i, v, th, th_run, n): smoothed levels, the levels for edges (0.35) and for runs (0.5) and the number of frames.
    `half` rows without v follow the last frame, as a mark there still has frames in reach. Edges and runs read this table
    several times, so a caller with many frames writes it first."""
    f = smooth3(frames.select(*key, F.col("i").cast("long").alias("i"), F.col(value).alias("__raw")), key, "__raw", "v")
    last = frames.groupBy(*key).agg((F.max("i") + 1).cast("long").alias("__n"))
    after = last.select(*key, F.explode(F.sequence(F.col("__n"), F.col("__n") + half - 1)).alias("i"), F.lit(None).cast("double").alias("__raw"), F.lit(None).cast("double").alias("v"))
    both = f.select(*key, "i", "__raw", "v").unionByName(after)
    near = Window.partitionBy(*key).orderBy("i").rowsBetween(-half, half - 1)
    both = _quantiles(both.withColumn("__near", F.collect_list("__raw").over(near)), "__near", {"__low": 0.15, "__high": 0.85})
    for name, frac in (("th", 0.35), ("th_run", 0.5)):
        level = F.col("__low") + frac * (F.col("__high") - F.col("__low"))
        both = both.withColumn(name, F.greatest(level, F.lit(floor)) if floor is not None else level)
    return both.drop("__low", "__high").withColumn("n", F.count("__raw").over(Window.partitionBy(*key))).drop("__raw")


def _frame(t: Column, fps: float) -> Column:
    return F.floor(t * fps)


def sizes(heard: DataFrame, key: Key) -> DataFrame:
    """(key, __n, __last): number of frames and number of the last row of `heard`; `edges` takes it, so that several need one."""
    return heard.groupBy(*key).agg(F.max("n").alias("__n"), F.max("i").alias("__last"))


def edges(marks: DataFrame, heard: DataFrame, key: Key, forward: bool = True, fps: float = FPS, quiet: int = QUIET_FRAMES, size: DataFrame | None = None) -> DataFrame:
    """Adds edge, in seconds: where sound near `at` ends (forward) or begins, looked for up to `limit`.

    marks: (key, at, limit, ...), distinct rows, in seconds; heard: as `sound` gives it. The scan begins 0.2 s before `at`
    (backward: 0.15 s after it), within the frames. Without frames of the key the edge is `at`. size: `sizes` of heard."""
    rest = [c for c in marks.columns if c not in key]
    size = sizes(heard, key) if size is None else size
    held = lambda t: F.greatest(F.lit(0), F.least(_frame(t, fps), F.col("__n") - 1))
    begin = held(F.col("at") - 0.2) if forward else held(F.col("at") + 0.15)
    m = marks.select(*key, F.struct(*rest).alias("__row"), "at", "limit").join(size, list(key), "left")
    m = m.select(*key, "__row", "__n", F.least(_frame(F.col("at"), fps), "__last").alias("mark"), begin.alias("start"), held(F.col("limit")).alias("limit"))
    some = scan(m, heard.select(*key, "i", "v", "th"), key, forward, quiet)
    at = F.when(F.col("__n") > 0, F.col("edge") / F.lit(float(fps))).otherwise(F.col("__row.at"))
    return some.select(*key, "__row.*", at.alias("edge"))


def guard_cut(cuts: DataFrame, frames: DataFrame, key: Key, level: float = -8.0, quiet: int = 12) -> DataFrame:
    """Adds ga, gb: a cut [a, b) in frames pulled in while its edges are louder than `level`; a dip of up to `quiet`
    frames does not stop it; ga = gb = a if nothing is left. frames: (key, i, v)."""
    near = _with_frames(cuts, frames, key, F.col("a"), F.col("b")).withColumn("__q", (F.col("v") <= level).cast("int"))
    for name, order in (("l", F.col("__i")), ("r", F.col("__i").desc())):
        step = Window.partitionBy(*cuts.columns).orderBy(order)
        run, seen = (x.over(step.rowsBetween(-quiet, 0)) for x in (F.sum("__q"), F.count("v")))
        near = near.withColumn("__stop", ((run == quiet + 1) & (seen == quiet + 1)).cast("int"))
        near = near.withColumn(f"__{name}", F.coalesce(F.max("__stop").over(step.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    loud = lambda side: F.when((F.col("__q") == 0) & (F.col(side) == 0), F.col("__i"))
    out = near.groupBy(*cuts.columns).agg(F.coalesce(F.max(loud("__l")) + 1, F.col("a")).alias("ga"), F.coalesce(F.min(loud("__r")), F.col("b")).alias("gb"))
    return out.withColumns({"ga": F.when(F.col("gb") > F.col("ga"), F.col("ga")).otherwise(F.col("a")), "gb": F.when(F.col("gb") > F.col("ga"), F.col("gb")).otherwise(F.col("a"))})


def islands(frames: DataFrame, key: Key, on: Column, bridge: float, least: float, fps: float = FPS, i: str = "i") -> DataFrame:
    """(key, s, e) in seconds: runs of frames that are on, joined over at most `bridge`, of at least `least`."""
    order = Window.partitionBy(*key).orderBy(i)
    df = frames.withColumn("__on", F.when(on, 1).otherwise(0)).withColumn("__run", F.sum(1 - F.col("__on")).over(order)).where("__on = 1")
    runs = df.groupBy(*key, "__run").agg((F.min(i) / fps).alias("s"), ((F.max(i) + 1) / fps).alias("e"))
    return merge(runs, key, bridge).where(F.col("e") - F.col("s") >= least)


def merge_passes(a: DataFrame, b: DataFrame, frames: DataFrame, key: Key, least_p: float = 0.5, above: float = 8.0, fps: float = FPS) -> DataFrame:
    """All words of pass a, and those of pass b that are probable, not empty, meet no word of a and whose loudest frame
    stands `above` the key's 20th percentile. words: (key, s, e, t, p) in seconds; frames: (key, i, v)."""
    base = frames.groupBy(*key).agg(F.percentile("v", 0.2).alias("__p20"))
    cand = b.where((F.col("p") >= least_p) & (F.col("e") > F.col("s")))
    ids = [*key, "s", "e", "t", "p"]
    cand = touching(cand, a, key, anti=True).select(*ids)
    f = frames.select(*(F.col(k).alias(f"__{k}") for k in key), "i", "v")
    on = (F.col("i") >= F.floor(F.col("s") * fps)) & (F.col("i") < F.floor(F.col("e") * fps) + 1)
    for k in key:
        on = on & (F.col(k) == F.col(f"__{k}"))
    loud = cand.join(f, on).groupBy(*ids).agg(F.max("v").alias("__v")).join(base, list(key)).where(F.col("__v") >= F.col("__p20") + above)
    return a.select(*ids).unionByName(loud.select(*ids))


def channel_stats(df: DataFrame, key: Key, x: str = "x", y: str = "y") -> DataFrame:
    """(key, peak_x, peak_y, corr, ratio): peak levels in dB, correlation without means, and ratio of RMS levels."""
    sq = lambda c: F.sum(F.col(c) * F.col(c))
    peak = lambda c: 20 * F.log10(F.max(F.abs(F.col(c))) + 1e-9)
    return df.groupBy(*key).agg(peak(x).alias("peak_x"), peak(y).alias("peak_y"), (F.sum(F.col(x) * F.col(y)) / (F.sqrt(sq(x) * sq(y)) + 1e-9)).alias("corr"), F.sqrt(sq(x) / sq(y)).alias("ratio"))


def two_mics(stats: DataFrame) -> DataFrame:
    """Adds two_mics: both channels live (above -60 dB) and not copies (correlation over 0.995 and levels within 12 %)."""
    live = (F.col("peak_x") > -60) & (F.col("peak_y") > -60)
    copy = (F.col("corr") > 0.995) & (F.abs(F.col("ratio") - 1) <= 0.12)
    return stats.withColumn("two_mics", live & ~copy)


def path_levels(df: DataFrame, key: Key, v_weight: float = 1.3) -> DataFrame:
    """(key, t, level): the largest tolerance below which a path (key, t, u, v) keeps the point; infinite at both ends.

    Where a stretch is split does not depend on the tolerance: always at its point farthest from the chord (the first of
    several). So one tree of splits serves all tolerances, and a point's level is the least distance on the way to it.
    One key's path is one task's; the tree is cut breadth first, so its depth costs no stack."""

    def levels(t: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t))
        out[[0, -1]] = np.inf
        stretches = [(0, len(t) - 1, np.inf)]
        while stretches:
            deeper = []
            for a, b, above in stretches:
                if b - a < 2 or above <= 0:
                    continue
                part = (t[a + 1 : b] - t[a]) / ((t[b] - t[a]) or 1)
                off = np.maximum(np.abs(u[a + 1 : b] - u[a] - part * (u[b] - u[a])), v_weight * np.abs(v[a + 1 : b] - v[a] - part * (v[b] - v[a])))
                m = a + 1 + int(off.argmax())
                out[m] = min(above, off.max())
                deeper += [(a, m, out[m]), (m, b, out[m])]
            stretches = deeper
        return out

    def run(pdf):
        pdf = pdf.sort_values("t")
        return pdf[[*key, "t"]].assign(level=levels(*(pdf[c].to_numpy(float) for c in ("t", "u", "v"))))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*key, "t"))
    return df.select(*key, "t", "u", "v").groupBy(*key).applyInPandas(run, f"{kinds}, level double")


def douglas_peucker(df: DataFrame, key: Key, tol: float, v_weight: float = 1.3) -> DataFrame:
    """(key, t) of the points that a path (key, t, u, v) keeps: the farthest from the chord, strictly over `tol`, splits it."""
    return path_levels(df, key, v_weight).where(F.col("level") > tol).select(*key, "t")


def chunk_track(df: DataFrame, key: Key, tols: Sequence[float], least: float, v_weight: float = 1.3) -> DataFrame:
    """(key, chunk, s, e, u, v): steady parts of a moving track (key, t, u, v), with the medians of their points.

    A track of span T has at most floor(T / least) parts, one at least. The first tolerance that keeps to it is used, else
    the last one. Bounds follow one another, and the end, by `least` or more; while there are too many, the bound whose
    neighbours are closest goes (the first of several). A point on a bound belongs to the later part. t is double."""
    path = path_levels(df.withColumn("t", F.col("t").cast("double")), key, v_weight)
    ends = path.groupBy(*key).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), *(F.sum((F.col("level") > x).cast("int")).alias(f"__n{i}") for i, x in enumerate(tols)), F.array_sort(F.collect_list(F.when(F.col("level") > min(tols), F.struct("t", "level")))).alias("__p"))
    most = F.greatest(F.lit(1), F.floor(F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-6)) / least).cast("int"))
    tol = F.lit(float(tols[-1]))
    for i in range(len(tols) - 2, -1, -1):
        tol = F.when(F.col(f"__n{i}") - 1 <= most, float(tols[i])).otherwise(tol)
    ends = ends.withColumns({"__most": most, "__tol": tol})
    inner = F.transform(F.filter("__p", lambda p: (p["level"] > F.col("__tol")) & (p["t"] > F.col("t0")) & (p["t"] < F.col("t1"))), lambda p: p["t"])
    far = lambda a, t: (t - F.element_at(a, -1) >= least) & (F.col("t1") - t >= least)
    ends = ends.withColumn("__b", F.aggregate(inner, F.array("t0"), lambda a, t: F.when(far(a, t), F.array_append(a, t)).otherwise(a)))
    ends = ends.withColumn("__b", F.when(F.col("t1") > F.col("t0"), F.array_append("__b", F.col("t1"))).otherwise(F.array("t0", "t1")))

    def thinner(a: Column, _: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(2), F.size(a) - 1), lambda i: F.struct((F.get(a, i) - F.get(a, i - 2)).alias("gap"), i.alias("i")))
        at = F.array_min(gaps)["i"]  # one-based place of the bound whose neighbours are closest
        return F.filter(a, lambda x, i: i != at - 1)

    over = F.greatest(F.size("__b") - 1 - F.col("__most"), F.lit(0))
    ends = ends.withColumn("__b", F.when(over > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(over, F.lit(1))), F.col("__b"), thinner)).otherwise(F.col("__b")))
    part = F.transform(F.sequence(F.lit(0), F.size("__b") - 2), lambda i: F.struct(i.alias("chunk"), F.get("__b", i).alias("s"), F.get("__b", i + 1).alias("e")))
    # each point finds its part in the key's own array of bounds: the number of inner bounds that are not after it
    points = df.select(*key, F.col("t").cast("double").alias("t"), "u", "v").join(ends.select(*key, "__b"), list(key))
    n = F.size(F.filter(F.slice("__b", 2, F.greatest(F.size("__b") - 2, F.lit(0))), lambda x: x <= F.col("t")))
    mid = points.groupBy(*key, n.alias("chunk")).agg(F.median("u").alias("u"), F.median("v").alias("v"))
    return ends.select(*key, F.explode(part).alias("p")).select(*key, "p.*").join(mid, [*key, "chunk"])


def smooth_bands(df: DataFrame, key: Key, value: str, out: str, limit: float, order: str = "band") -> DataFrame:
    """[.25, .5, .25] smoothing with repeated edges, held to +-limit."""
    w = Window.partitionBy(*key).orderBy(order)
    x = 0.25 * F.coalesce(F.lag(value, 1).over(w), F.col(value)) + 0.5 * F.col(value) + 0.25 * F.coalesce(F.lead(value, 1).over(w), F.col(value))
    return df.withColumn(out, F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)))
