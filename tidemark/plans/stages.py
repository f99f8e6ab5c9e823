"""Stages of a plan as table operators: words and sound in, pieces out. Times are seconds; the key is `short`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals, rules, signals
from ..operators.lineage import settled
from ..sources import media

Key = Sequence[str]
SLIVER = 3  # frames; shorter pieces go


@dataclass(frozen=True)
class Rough:
    """The defaults of the rough cut."""

    pre: float = 0.15
    post: float = 0.25
    min_gap: float = 0.9
    head_min: float = 0.3
    guard_db: float = 8.0
    guard_quiet: float = 0.25
    min_cut_frames: int = 4
    review_min: float = 2.5


NO_AUDIO = "[ingest] no audible audio channel: left out of every stage"  # fixed value: the note that later stages look for


def newest_batch(names: DataFrame, order: str = "DMY", skip: Sequence[str] = (), name: str = "name") -> DataFrame:
    """The row of the newest dated folder (ties: the last by path), if any. names: (name, path)."""
    return media.batches(names, order, skip, name).orderBy(F.col("date").desc(), F.col("path").desc()).limit(1)


def ingest(info: DataFrame, levels: DataFrame, alike: DataFrame, empty_db: float = -60.0) -> DataFrame:
    """(short, path, fps, duration, mic, a1, a2, empty, enabled, notes): clips as shorts, with the channels that carry sound.

    info: (short, path, fps, duration); levels: (path, stream, channel, peak) in dB; alike: (path, corr, ratio) of the first two
    live channels, as `signals.channel_stats` gives them. mic: two if a second live channel is not a copy of the first, single
    otherwise, none without channels. Channels are [stream, channel]; a clip without live ones is not enabled."""
    live = F.col("peak") > empty_db
    place = F.struct("stream", "channel")
    listed = lambda on: F.transform(F.array_sort(F.collect_list(F.when(on, place))), lambda x: F.array(x["stream"], x["channel"]))
    per = levels.groupBy("path").agg(listed(live).alias("live"), listed(~live).alias("empty"))
    copy = F.coalesce((F.col("corr") > 0.995) & (F.abs(F.col("ratio") - 1) < 0.12), F.lit(False))
    df = info.select("short", "path", "fps", "duration").join(per, "path", "left").join(alike.select("path", copy.alias("copy")), "path", "left")
    two = (F.size("live") > 1) & ~F.coalesce("copy", F.lit(False))
    mic = F.when(F.col("live").isNull(), "none").when(two, "two").otherwise("single")
    a1 = F.get("live", F.lit(0))
    none = F.array().cast("array<string>")
    return df.select("short", "path", "fps", "duration", mic.alias("mic"), a1.alias("a1"), F.when(two, F.get("live", F.lit(1))).alias("a2"), F.coalesce("empty", F.array().cast(per.schema["empty"].dataType)).alias("empty"), a1.isNotNull().alias("enabled"), F.when(a1.isNull(), F.array(F.lit(NO_AUDIO))).otherwise(none).alias("notes"))


def rough_cuts(words: DataFrame, frames: DataFrame, shorts: DataFrame, key: Key, c: Rough = Rough()) -> DataFrame:
    """(key, s, e, reason): where nobody speaks, pulled in while the sound there is loud. frames: (key, i, db);
    shorts: (key, duration, fps)."""
    fps_e = float(signals.FPS)
    size = frames.groupBy(*key).agg(F.count("*").alias("__n"))
    cuts = rules.speech_gaps(words, shorts, key, c.pre, c.post, c.min_gap, c.head_min).distinct()
    frame = lambda t: F.bround(F.col(t) * fps_e, 0).cast("long")
    cuts = cuts.join(size, list(key), "left").withColumns({"a": frame("s"), "b": F.least(frame("e"), F.coalesce("__n", frame("e")))})
    cuts = signals.guard_cut(cuts, frames.select(*key, F.col("i").cast("long").alias("i"), F.col("db").alias("v")), key, -c.guard_db, int(c.guard_quiet * fps_e))
    gone = F.col("gb") <= F.col("ga")
    s = F.when(F.col("ga") > F.col("a"), F.greatest("s", F.col("ga") / fps_e)).otherwise(F.col("s"))
    e = F.when(F.col("gb") < F.col("b"), F.least("e", F.col("gb") / fps_e)).otherwise(F.col("e"))
    cuts = cuts.where(~gone | (F.col("b") <= F.col("a"))).select(*key, s.alias("s"), e.alias("e"), "reason")
    return cuts.join(shorts.select(*key, "fps"), list(key)).where(F.col("e") - F.col("s") >= c.min_cut_frames / F.col("fps")).drop("fps")


def rough(words: DataFrame, frames: DataFrame, shorts: DataFrame, key: Key, fps: float, c: Rough = Rough(), shown: DataFrame | None = None, review: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pieces (key, pos, s, e, flags) and protected ranges (key, s, e) of the rough cut.

    Long gaps are protected for review, or, given `shown` (key, s, e), what shows something; without either nothing is.
    Kept ranges grow to whole frames; parts of protected ranges are flagged. A short without words keeps the whole clip."""
    cuts = settled(rough_cuts(words, frames, shorts, key, c))
    protect = shown if shown is not None else rules.long_gaps(cuts, c.review_min)
    protect = protect.select(*key, "s", "e") if review or shown is not None else protect.select(*key, "s", "e").limit(0)
    spoken = shorts.join(words.select(*key).distinct(), list(key), "left_semi")
    applied = intervals.subtract(cuts, protect, key)
    keep = intervals.invert(applied, spoken.select(*key, F.lit(0.0).alias("lo"), F.col("duration").alias("hi")), key)
    keep = settled(intervals.snap_keep(keep, spoken, key, fps).where(F.col("e") - F.col("s") >= SLIVER / fps))
    none = F.array().cast("array<string>")
    parts = intervals.split_protected(keep.withColumn("flags", none), intervals.merge(protect, key), key)
    whole = shorts.join(words.select(*key).distinct(), list(key), "left_anti").select(*key, F.lit(0.0).alias("s"), F.col("duration").alias("e"), none.alias("flags"))
    return numbered(parts.select(*key, "s", "e", "flags").unionByName(whole), key), protect


def fine(pieces: DataFrame, cuts: DataFrame, key: Key, fps: float) -> DataFrame:
    """Pieces without the cuts, numbered anew; what is left keeps its other columns, slivers go."""
    return numbered(intervals.apply_cuts(pieces.drop("pos"), cuts, key, SLIVER / fps), key)


def numbered(pieces: DataFrame, key: Key) -> DataFrame:
    return pieces.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("s", "e")) - 1)
