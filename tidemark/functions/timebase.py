"""Frame and time expressions. Frames round half to even; 29.97 stands for 30000/1001 and its siblings alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nominal rates and the exact ones that they mean.
NTSC = ((23.976, 24000), (29.97, 30000), (47.952, 48000), (59.94, 60000), (119.88, 120000))


def exact(fps: float) -> float:
    """The rate that a nominal rate within 0.01 means."""
    return next((n / 1001 for nominal, n in NTSC if abs(fps - nominal) < 0.01), float(fps))


def exact_rate(fps: Column) -> Column:
    out = fps.cast("double")
    for nominal, n in NTSC:
        out = F.when(F.abs(fps - nominal) < 0.01, F.lit(n / 1001)).otherwise(out)
    return out


def to_frame(seconds: Column, fps: float) -> Column:
    return F.bround(seconds * exact(fps), 0).cast("long")


def to_seconds(frame: Column, fps: float) -> Column:
    return frame / F.lit(exact(fps))


def timecode(frame: Column, fps: float) -> Column:
    """Non-drop HH:MM:SS:FF."""
    base = round(exact(fps))
    s = F.floor(frame / base)
    part = lambda n, of: (F.floor(s / n) % of).cast("long")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 3600).cast("long"), part(60, 60), part(1, 60), F.pmod(frame, F.lit(base)).cast("long"))


def srt_time(seconds: Column) -> Column:
    ms = F.bround(seconds * 1000, 0).cast("long")
    part = lambda n, of: (F.floor(ms / n) % of).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000).cast("long"), part(60000, 60), part(1000, 60), (ms % 1000).cast("long"))
