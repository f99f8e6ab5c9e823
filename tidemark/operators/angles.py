"""Where speakers change and how each piece is framed: cuts at turns, and zoom, pan and tilt around the speaker's head."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import signals
from .intervals import overlapping
from .lineage import settled
from .timeline import Canvas

Key = Sequence[str]
OK, BAD = 80.0, 150.0  # pixels between the head and its place: centred up to the first, wrong beyond the second
# The notes and marker names that editors look for.
OTHER = "speaker not visible, stayed on the other person"
COVER = "no usable face (cover %.2f/%.2f)"
NO_FACE = "no usable face"
ZOOMED = "zoomed to %.2f to centre the head"
TINY = "tiny, copied the previous framing"
OFF = "cannot centre the head"
BAD_NAME, STAB_NAME = "BAD ANGLE - fix", "STABILISED"
STEADY = " steady shots; add keyframes to refine"
AHEAD = 8  # points at a piece's start that say where the head is


def turn_cuts(spoken: DataFrame, words: DataFrame, sents: DataFrame, heard: DataFrame, key: Key, fps: float, lead_frames: int = 2) -> DataFrame:
    """(key, t): for each turn but the first, `lead_frames` before the sound of the first sentence that starts with it or later.
    spoken: (key, s, e, spk); sents: (key, sent, s, ...) with first, the idx of its first word."""
    later = F.row_number().over(Window.partitionBy(*key).orderBy("s")) > 1
    t = spoken.withColumn("__later", later).where("__later").select(*key, (F.col("s") - 1e-6).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(sents.schema["first"].dataType).alias("__first"))
    s = sents.select(*key, F.col("s").alias("__at"), F.lit(1).alias("__kind"), F.col("first").alias("__first"))
    order = Window.partitionBy(*key).orderBy(F.col("__at").desc(), F.col("__kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    first = t.unionByName(s).withColumn("idx", F.last("__first", ignorenulls=True).over(order)).where("__kind = 0").select(*key, "idx").distinct()
    marks = words.select(*key, "idx", F.col("s").alias("at")).join(first, [*key, "idx"]).withColumn("limit", F.greatest(F.col("at") - 0.4, F.lit(0.0)))
    return signals.edges(marks, heard, key, False).select(*key, F.greatest(F.col("edge") - lead_frames / fps, F.lit(0.0)).alias("t")).distinct()


def _first_fit(residuals: list[Column], start: Column, limit: float) -> Column:
    """Number of the first step from `start` on within `limit`; the last step if none is."""
    out = F.lit(len(residuals) - 1)
    for i in range(len(residuals) - 2, -1, -1):
        out = F.when((start <= i) & (residuals[i] <= limit), i).otherwise(out)
    return out


def frame_pieces(pieces: DataFrame, samples: DataFrame, key: Key, canvas: Canvas, sw: float, sh: float, base: Sequence[float] = (1.0, 1.2, 1.37, 1.5), face_px: Sequence[float] = (190.0, 150.0), min_cover: float = 0.35, static: tuple[float, float] = (90.0, 70.0), tols: Sequence[float] = (45.0, 60.0, 80.0, 110.0, 150.0, 220.0), least: float = 1.5) -> DataFrame:
    """(key, pos, part, s, e, spk, who, zoom, pan, tilt, flags, note): every piece framed around a head, in one zoom for the key.

    pieces: (key, pos, s, e, spk), spk H, G or empty (as H); samples: (key, t, H, G), a nullable struct of cx, ey and w each.
    who: the speaker if on min_cover of the piece's samples, else the other one if on 0.6, else nobody. The zoom is the first step,
    from that of the mean face width on, that centres pieces of 0.7 of the length; a piece may go further to get its head
    within BAD. A head that moves over `static` splits the piece into steady parts (flag stab). Without a head a piece of up to
    0.67 s copies the framing before it, a longer one stands at the first step (bad_angle). Lengths are of 4K pixels. Only the simplification of moving
    tracks runs in Python, a piece at a time."""
    k = sw / 3840.0
    zooms = canvas.steps(sw, sh, base)
    at = [*key, "pos"]
    p = pieces.select(*at, "s", "e", "spk")
    points = samples.select(*key, F.col("t").alias("s"), F.col("t").alias("e"), "H", "G")
    wide = p.select(*at, (F.col("s") - 0.06).alias("s"), (F.col("e") + 0.06).alias("e"), F.col("s").alias("a"), F.col("e").alias("z"), "spk")
    near = overlapping(points, wide, key, 10.0).withColumnRenamed("s", "t").where((F.col("t") >= F.col("a") - 0.05) & (F.col("t") <= F.col("z") + 0.05))
    in_ = F.col("t") <= F.col("z")
    seen = near.groupBy(*at).agg(F.sum(in_.cast("int")).alias("n"), *(F.sum((in_ & F.col(w).isNotNull()).cast("int")).alias(f"n{w}") for w in "HG"))
    p = p.join(seen, at, "left").withColumn("sp", F.when(F.col("spk") == "G", "G").otherwise("H"))
    cover = {w: F.coalesce(F.col(f"n{w}") / F.greatest("n", F.lit(1)), F.lit(0.0)) for w in "HG"}
    own, other = (F.when(F.col("sp") == w, cover["H"]).otherwise(cover["G"]) for w in "HG")
    swap = F.when(F.col("sp") == "H", "G").otherwise("H")
    p = p.withColumn("who", F.when(own >= min_cover, F.col("sp")).when(other >= 0.6, swap))
    p = p.withColumn("note", F.when(own >= min_cover, "").when(other >= 0.6, OTHER).otherwise(F.format_string(COVER, cover["H"], cover["G"])))
    p = p.select(*at, "s", "e", "spk", "who", "note")

    track = near.join(p.select(*at, "who"), at).withColumn("f", F.when(F.col("who") == "H", F.col("H")).when(F.col("who") == "G", F.col("G"))).where("f IS NOT NULL")
    track = track.select(*at, "t", "f.cx", "f.ey", "f.w")
    track = settled(signals.median_smooth(signals.median_smooth(track, at, "cx", "u", i="t"), at, "ey", "v", i="t"))
    head = F.row_number().over(Window.partitionBy(*at).orderBy("t")) <= AHEAD
    first = lambda c: F.median(F.when(F.col("__head"), F.col(c)))
    heads = track.withColumn("__head", head).groupBy(*at).agg(
        first("cx").alias("ru"), first("ey").alias("rv"), first("u").alias("u0"), first("v").alias("v0"), F.median("w").alias("fw"),
        ((F.max("u") - F.min("u") > static[0] * k) | (F.max("v") - F.min("v") > static[1] * k)).alias("moves"), F.count("*").alias("points"),
    )
    p = settled(p.join(heads, at, "left").withColumn("dur", F.col("e") - F.col("s")))

    # one zoom step for the key
    held = p.where("fw IS NOT NULL")
    step0 = canvas.pick_step(F.sum(F.col("fw") * F.col("dur")) / F.sum("dur"), sw, sh, base, face_px)
    fits = [F.sum(F.when(canvas.residual(F.col("ru"), F.col("rv"), F.lit(z), sw, sh) <= OK, F.col("dur")).otherwise(0.0)) >= 0.7 * F.sum("dur") for z in zooms]
    per = held.groupBy(*key).agg(step0.alias("step0"), *(f.alias(f"fit{i}") for i, f in enumerate(fits)))
    chosen = _first_fit([F.when(F.col(f"fit{i}"), 0.0).otherwise(1.0) for i in range(len(zooms))], F.col("step0"), 0.5)
    p = p.join(per.select(*key, chosen.alias("step")), list(key), "left")
    far = lambda z, u="u0", v="v0": canvas.residual(F.col(u), F.col(v), z, sw, sh)
    p = p.withColumn("zs", F.when(F.col("fw").isNotNull(), _first_fit([far(F.lit(z)) for z in zooms], F.col("step"), BAD)))
    z = F.get(F.array(*map(F.lit, zooms)), F.col("zs"))
    p = p.withColumns({"zoom": z, "note": F.when((F.col("zs") > F.col("step")), F.concat_ws("; ", F.when(F.col("note") != "", F.col("note")), F.format_string(ZOOMED, z))).when(F.col("who").isNotNull() & F.col("fw").isNull(), NO_FACE).otherwise(F.col("note"))})

    # steady parts of moving heads
    moving = p.where("moves AND points >= 4").select(*at)
    chunks = signals.chunk_track(track.join(moving, at, "left_semi").select(*at, "t", "u", "v"), at, [t * k for t in tols], least)
    chunks = chunks.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("chunk", "e", "u", "v"))).alias("chunks"))
    one = F.array(F.struct(F.lit(0).alias("chunk"), F.col("e").cast("double").alias("e"), F.col("u0").alias("u"), F.col("v0").alias("v")))
    p = p.join(chunks, at, "left").withColumn("chunks", F.coalesce("chunks", one)).withColumn("count", F.size("chunks"))
    p = p.withColumn("c", F.explode("chunks")).withColumn("part", F.col("c.chunk"))
    before = F.lag("c.e").over(Window.partitionBy(*at).orderBy("part"))
    p = p.withColumns({"s2": F.coalesce(before, F.col("s").cast("double")), "e2": F.when(F.col("part") == F.col("count") - 1, F.col("e").cast("double")).otherwise(F.col("c.e")), "u": F.col("c.u"), "v": F.col("c.v")})
    pan, tilt = canvas.pan_tilt(*canvas.frame_point(F.col("u"), F.col("v"), F.col("zoom"), sw, sh))
    lost = F.col("fw").isNull()
    off = far(F.col("zoom"), "u", "v") > BAD
    tiny = lost & (F.col("dur") <= 0.67)
    flags = F.array_compact(F.array(F.when(~lost & (F.col("count") > 1), "stab"), F.when(F.when(lost, True).otherwise(off), "bad_angle")))
    p = p.withColumns({
        "x": F.struct(F.when(lost, "").otherwise(F.col("who")).alias("who"), F.when(lost, zooms[0]).otherwise(F.col("zoom")).alias("zoom"), F.when(lost, 0.0).otherwise(F.round(pan, 1)).alias("pan"), F.when(lost, 0.0).otherwise(F.round(tilt, 1)).alias("tilt")),
        "flags": flags,
        "note": F.when(~lost & off, F.concat_ws("; ", F.when(F.col("note") != "", F.col("note")), F.lit(OFF))).otherwise(F.col("note")),
        "tiny": tiny,
    })
    order = Window.partitionBy(*key).orderBy("pos", "part")
    source = F.last(F.when(~F.col("tiny"), F.col("x")), ignorenulls=True).over(order)
    p = p.withColumn("from", source).withColumn("copied", F.col("tiny") & F.col("from").isNotNull())
    x = F.when(F.col("copied"), F.col("from")).otherwise(F.col("x"))
    return p.withColumn("x", x).select(
        *at, "part", F.col("s2").alias("s"), F.col("e2").alias("e"), "spk", "x.*", F.when(F.col("copied"), F.array().cast("array<string>")).otherwise(F.col("flags")).alias("flags"), F.when(F.col("copied"), TINY).otherwise(F.col("note")).alias("note"),
    )


def angle_markers(framed: DataFrame, key: Key) -> DataFrame:
    """(key, t, color, name, note) of framed pieces in source time: heads that cannot be centred, and pieces in steady parts."""
    bad = framed.where(F.array_contains("flags", "bad_angle")).select(*key, F.col("s").alias("t"), F.lit("Red").alias("color"), F.lit(BAD_NAME).alias("name"), "note")
    n = F.concat(F.count("*").cast("string"), F.lit(STEADY))
    stab = framed.where(F.array_contains("flags", "stab")).groupBy(*key, "pos").agg(F.min("s").alias("t"), n.alias("note"))
    return bad.unionByName(stab.select(*key, "t", F.lit("Green").alias("color"), F.lit(STAB_NAME).alias("name"), "note"))
