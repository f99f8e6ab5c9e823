"""Text forms of pieces and captions: cut lists, subtitles, and a summary of what stages did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timebase import exact, srt_time, timecode
from ..operators.timeline import frame_bounds

Key = Sequence[str]


def start_frames(tc: Column, fps: float) -> Column:
    """Frames of an HH:MM:SS:FF time code; empty is 0."""
    p = F.split(F.regexp_replace(F.coalesce(tc, F.lit("")), ";", ":"), ":")
    part = lambda i: F.coalesce(F.try_element_at(p, F.lit(i + 1)).try_cast("long"), F.lit(0))
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * round(exact(fps)) + part(3)


def edl_events(pieces: DataFrame, key: Key, fps: float, unit: float = 1, tl_fps: float | None = None) -> DataFrame:
    """(key, pos, line, from_name, comment): a CMX3600 event of each piece (pos from 0, s, e, file, start_tc, note)."""
    tl_fps = tl_fps or fps
    p = frame_bounds(pieces, key, tl_fps, unit)
    name = F.element_at(F.split("file", "/"), -1)
    reel = F.rpad(F.regexp_replace(F.upper(F.substring(F.regexp_replace(name, r"\.[^.]*$", ""), 1, 8)), " ", "_"), 8, " ")
    s_in = start_frames(F.col("start_tc"), fps) + F.bround(F.col("s") * exact(fps) / unit, 0).cast("long")
    p = p.withColumn("__in", s_in).withColumn("__out", F.col("__in") + F.bround((F.col("f_out") - F.col("f_in")) * exact(fps) / exact(tl_fps), 0).cast("long"))
    line = F.concat(
        F.format_string("%03d", F.col("pos") + 1), F.lit("  "), reel, F.lit(" AA/V  C        "),
        F.concat_ws(" ", timecode(F.col("__in"), fps), timecode(F.col("__out"), fps), timecode(F.col("f_in"), tl_fps), timecode(F.col("f_out"), tl_fps)),
    )
    return p.select(*key, "pos", line.alias("line"), F.concat(F.lit("* FROM CLIP NAME: "), name).alias("from_name"), F.when(F.col("note") != "", F.concat(F.lit("* COMMENT: "), "note")).alias("comment"))


def edl(events: DataFrame, key: Key, title: Column) -> DataFrame:
    """(key, edl): the whole cut list of each key as one text."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line", "from_name", "comment"))), lambda x: F.concat_ws("\n", x["line"], x["from_name"], x["comment"]))
    head = F.concat(F.lit("TITLE: "), title, F.lit("\nFCM: NON-DROP FRAME\n\n"))
    return events.groupBy(*key).agg(F.concat(F.first(head), F.concat_ws("\n", body), F.lit("\n")).alias("edl"))


def srt(captions: DataFrame, key: Key, unit: float = 1, skip: Sequence[str] = (), order: str = "cap") -> DataFrame:
    """(key, srt): numbered subtitle blocks of captions (cap, s, e, text, kind), without kinds to skip."""
    c = captions.where(~F.col("kind").isin(*skip)) if skip else captions
    one = F.concat(srt_time(F.col("s") / unit), F.lit(" --> "), srt_time(F.col("e") / unit), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("b"))))
    return c.groupBy(*key).agg(F.concat_ws("", F.transform(rows, lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["b"]))).alias("srt"))


def without_covered(captions: DataFrame, overlays: DataFrame, key: Key) -> DataFrame:
    """Captions that no overlay (s, e) covers from start to end."""
    o = overlays.select(*(F.col(k).alias(f"__{k}") for k in key), F.col("s").alias("__s"), F.col("e").alias("__e"))
    on = (F.col("__s") <= F.col("s")) & (F.col("__e") >= F.col("e"))
    for k in key:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return captions.join(o, on, "left_anti")


def summary(shorts: DataFrame, pieces: DataFrame, cuts: DataFrame, markers: DataFrame, key: Key) -> DataFrame:
    """(key, before, after, pieces, cuts, reasons, markers): one row for each short; reasons: `2 gap, 1 head` in order."""
    p = pieces.groupBy(*key).agg(F.count("*").alias("pieces"), F.sum(F.col("e") - F.col("s")).alias("after"))
    by = cuts.groupBy(*key, "reason").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["reason"])), ", ")
    c = by.groupBy(*key).agg(F.sum("n").alias("cuts"), text.alias("reasons"))
    m = markers.groupBy(*key).agg(F.count("*").alias("markers"))
    out = shorts.select(*key, F.col("duration").alias("before")).join(p, list(key), "left").join(c, list(key), "left").join(m, list(key), "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return out.select(*key, "before", F.coalesce("after", F.col("before") * 0).alias("after"), zero("pieces"), zero("cuts"), F.coalesce("reasons", F.lit("")).alias("reasons"), zero("markers"))


def review_flags(shorts: DataFrame, pieces: DataFrame, markers: DataFrame, key: Key, remark: str) -> DataFrame:
    """(key, flags): what a person should look at: bad angles, stretches kept for review, a remark among the notes, no words.
    shorts: (key, notes, asr); pieces: (key, flags); markers: (key, name)."""
    bad = pieces.groupBy(*key).agg(F.sum(F.array_contains("flags", "bad_angle").cast("int")).alias("bad"))
    review = markers.groupBy(*key).agg(F.sum(F.col("name").startswith("CHECK").cast("int")).alias("review"))
    s = shorts.join(bad, list(key), "left").join(review, list(key), "left")
    count = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    noted = F.when(F.exists(F.coalesce("notes", F.array().cast("array<string>")), lambda n: n.contains(remark)), remark)
    parts = (count("bad", " bad angle"), count("review", " silent stretch(es) to review"), noted, F.when(F.col("asr") == "energy", "no word timings"))
    return s.select(*key, F.array_compact(F.array(*parts)).alias("flags"))


def markdown(summary_rows: DataFrame) -> str:
    """The summary as a Markdown table, a line a short; collected, as it is for reading."""
    cols = summary_rows.columns
    rows = [[str(v) for v in r] for r in summary_rows.orderBy(*cols[:1]).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [cols, ["---"] * len(cols), *rows])
