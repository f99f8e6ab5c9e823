"""The edit plan as tables, its JSON form, and what rerunning a stage makes void.

Tables, keyed by `short`: shorts, pieces(pos, ...), overlays(stage, ...), markers(stage, ...), notes(pos, note),
stats(name, ...), snaps(stage, pos, ...). Stages run in the order of STAGES; the first CUT_STAGES change the pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAGES = ("rough", "angles", "fine", "captions", "products", "behind", "broll", "stamps", "music", "audio")
CUT_STAGES = STAGES[:3]
# The statistics that each stage leaves.
STAGE_STATS = {
    "rough": ("rough", "protect"),
    "angles": ("angles", "turns", "roles"),
    "fine": ("fine",),
    "captions": ("captions", "caption_list", "mute"),
    "products": ("products",),
    "behind": ("behind", "behind_src"),
    "broll": ("broll",),
    "stamps": ("stamp",),
    "music": ("music",),
    "audio": ("audio",),
}

PIECE = "src_in double, src_out double, spk string, who string, zoom double, pan double, tilt double, flags array<string>, note string, media string, media_in double"
OVERLAY = "kind string, file string, t_in double, t_out double, track int, props map<string,string>, label string, stage string"
MARKER = "t double, color string, name string, note string, stage string"

def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{f.strip().split(' ', 1)[0]}: {f.strip().split(' ', 1)[1]}" for f in _fields(ddl)) + ">"


def _fields(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


SHORT = (
    "name string, source string, fps double, width int, height int, duration double, enabled boolean, "
    f"pieces array<{_struct(PIECE)}>, overlays array<{_struct(OVERLAY)}>, markers array<{_struct(MARKER)}>, "
    f"notes array<string>, voice string, subtitles string, stats map<string,string>, snaps map<string,array<{_struct(PIECE)}>>"
)
PLAN = f"batch map<string,string>, timeline map<string,string>, shorts array<{_struct(SHORT)}>, stages array<string>, version int"
# What a field is when the document does not hold it.
PIECE_DEFAULTS = {"spk": "", "who": "", "zoom": 1.0, "pan": 0.0, "tilt": 0.0, "note": "", "media": "", "media_in": 0.0}


def stage_rank(stage: Column) -> Column:
    """0 for the first stage; null for an unknown one."""
    return reduce(lambda rest, i: F.when(stage == STAGES[i], i).otherwise(rest), range(len(STAGES)), F.lit(None).cast("int"))


def selected(shorts: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The enabled shorts, of the listed names if any are."""
    on = F.coalesce(F.col("enabled"), F.lit(True))
    return shorts.where(on & F.col("name").isin(*names)) if names else shorts.where(on)


def clear_from(rows: DataFrame, stage: str, column: str = "stage", keep_own: bool = False) -> DataFrame:
    """Rows (overlays, markers, snapshots) without those of the stage (unless keep_own) and of later ones."""
    rank = stage_rank(F.col(column))
    first = STAGES.index(stage) + int(keep_own)
    return rows.where(rank.isNull() | (rank < first))


def clear_notes(notes: DataFrame, stage: str, note: str = "note") -> DataFrame:
    """Notes without those marked [stage] with the stage or a later one."""
    marked = F.regexp_extract(F.col(note), r"^\[(\w+)\]", 1)
    return notes.where(~marked.isin(*STAGES[STAGES.index(stage) :]))


def clear_stats(stats: DataFrame, stage: str, name: str = "name") -> DataFrame:
    gone = [k for s in STAGES[STAGES.index(stage) :] for k in STAGE_STATS[s]]
    return stats.where(~F.col(name).isin(*gone))


def add_note(shorts: DataFrame, note: Column) -> DataFrame:
    """Adds a note (null: none) to the notes of each short unless it is there."""
    return shorts.withColumn("notes", F.when(note.isNull(), F.col("notes")).otherwise(F.array_union(F.coalesce("notes", F.array().cast("array<string>")), F.array(note))))


def pieces_before(snaps: DataFrame, shorts: DataFrame, stage: str) -> DataFrame:
    """(short, pos, s, e): pieces as the last cut stage before `stage` left them; the whole clip where none has.
    snaps: (short, stage, pos, s, e); shorts: (short, duration)."""
    before = snaps.withColumn("__r", stage_rank(F.col("stage"))).where((F.col("__r") < STAGES.index(stage)) & F.col("stage").isin(*CUT_STAGES))
    last = before.withColumn("__last", F.max("__r").over(Window.partitionBy("short"))).where("__r = __last").select("short", "pos", "s", "e")
    none = shorts.join(last.select("short").distinct(), "short", "left_anti")
    zero = F.col("duration") * 0
    return last.unionByName(none.select("short", F.lit(0).cast(last.schema["pos"].dataType).alias("pos"), zero.alias("s"), F.col("duration").alias("e")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A plan document: unknown keys are dropped, missing ones null; `pieces` fills in the defaults."""
    return spark.read.schema(PLAN).option("multiLine", True).json(path)


def save(plan: DataFrame, path: str) -> None:
    """Writes the document as one JSON file in a folder. It is written beside the folder first and takes its place by renaming, so
    a plan can be saved where it was loaded from, and a failed run leaves the old one; readers see the old, the new or no folder."""
    spark = plan.sparkSession
    aside, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    plan.coalesce(1).write.json(aside)
    to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(to(path)) and not files.rename(to(path), to(old)):
        raise OSError(f"cannot move {path}")
    if not files.rename(to(aside), to(path)):
        files.rename(to(old), to(path))
        raise OSError(f"cannot write {path}")
    files.delete(to(old), True)


def shorts(plan: DataFrame) -> DataFrame:
    return plan.select(F.explode("shorts").alias("s")).select("s.*").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def pieces(plan: DataFrame) -> DataFrame:
    """(short, pos, piece fields) with defaults."""
    p = shorts(plan).select(F.col("name").alias("short"), F.posexplode("pieces").alias("pos", "p")).select("short", "pos", "p.*")
    fill = {c: F.coalesce(c, F.lit(v)) for c, v in PIECE_DEFAULTS.items()}
    return p.withColumns(fill | {"flags": F.coalesce("flags", F.array().cast("array<string>"))})


def children(plan: DataFrame, kind: str) -> DataFrame:
    """(short, pos, fields) of overlays or markers."""
    return shorts(plan).select(F.col("name").alias("short"), F.posexplode(kind).alias("pos", "c")).select("short", "pos", "c.*")


def placement(pieces_: DataFrame, key: Sequence[str], fps: float, gap: int = 0, unit: float = 1) -> DataFrame:
    """(key, pos, track, record, source, frames): one row for each item that a builder places on the timeline."""
    from ..operators.timeline import frame_bounds

    p = frame_bounds(pieces_, key, fps, unit)
    source = F.bround(F.col("s") * fps / unit, 0).cast("long")
    return p.select(*key, "pos", F.lit(1).alias("track"), (F.col("f_in") + gap).alias("record"), source.alias("source"), (F.col("f_out") - F.col("f_in")).alias("frames"))


def reconcile(plan: DataFrame, actual: DataFrame, key: Sequence[str], slack: int = 1) -> DataFrame:
    """(key, pos, issue): planned and read-back items by place: missing, extra, moved, wrong length or source. Starts must
    agree, lengths and source offsets to within `slack` frames."""
    a = actual.select(*key, "pos", *(F.col(c).alias(f"__{c}") for c in ("record", "source", "frames")))
    both = plan.join(a, [*key, "pos"], "full")
    issue = (
        F.when(F.col("__record").isNull(), "missing")
        .when(F.col("record").isNull(), "extra")
        .when(F.col("record") != F.col("__record"), "start")
        .when(F.abs(F.col("frames") - F.col("__frames")) > slack, "length")
        .when(F.abs(F.col("source") - F.col("__source")) > slack, "source")
    )
    return both.select(*key, "pos", issue.alias("issue")).where("issue IS NOT NULL")


def layout(shorts_: DataFrame, order: str, frames: str, gap: int, buckets: int = 64) -> DataFrame:
    """Adds offset: where each short begins when all stand one after another with `gap` frames between. order: a number. Sums are
    taken within buckets between approximate quantiles of it (fixed once, so recomputed tasks agree), then the sums of the buckets
    before are added, so that no task needs the whole table."""
    edges = sorted(set(shorts_.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.002)))
    bucket = reduce(lambda n, x: n + F.when(F.col(order) > x, 1).otherwise(0), edges, F.lit(0))
    s = shorts_.withColumn("__b", bucket)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = s.groupBy("__b").agg(F.sum(F.col(frames) + gap).alias("__s"))
    sums = sums.select("__b", before("__s", Window.orderBy("__b")).alias("__off"))  # a row a bucket
    s = s.withColumn("__in", before(F.col(frames) + gap, Window.partitionBy("__b").orderBy(order)))
    return s.join(F.broadcast(sums), "__b").select(*shorts_.columns, (F.col("__in") + F.col("__off")).alias("offset"))
