"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Chat logs often hold a conversation many times, each time with the turns so far. A rolling hash after each turn names
that prefix; a conversation whose whole hash is an inner prefix of another one is dropped by an anti-join, and of equal
conversations the least id stays. What is left is rendered.

The rolling hash is a running XOR of two 64-bit hashes of each turn's digest and position. A conversation is cut in blocks
by turn number; running values inside a block get those of the blocks before it, so no task needs a whole conversation.
Digests are shuffled for all of this; texts are shuffled once, by block, for the rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Turn numbers that one block spans, and turns that one rendered part holds.
BLOCK, PART_TURNS = 512, 256
_NONE = -(1 << 60)
_LANES = ("x0", "x1")


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, block, turn, d0, d1, line): c wraps the id so that null ids are equal; d0 and d1 are a digest of role and text in
    which null, empty and shifted borders differ; turns without a number are dealt to blocks by digest, before all others."""
    marked = lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    t = turns.select(F.struct(F.col(conv).alias("id")).alias("c"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("x"))
    digest = F.sha2(F.concat(marked(F.col("r")), marked(F.col("x"))), 256)
    half = lambda i: F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long")
    t = t.withColumns({"d0": half(0), "d1": half(1)})
    block = F.when(F.col("turn").isNull(), F.lit(_NONE) + F.shiftright("d0", 54)).otherwise(F.floor(F.col("turn") / BLOCK))
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("r", F.lit("unknown")), F.lit("\n"), F.coalesce("x", F.lit("")), F.lit("<|im_end|>\n"))
    return t.select("c", block.alias("block"), "turn", "d0", "d1", line.alias("line"))


def _prefixes(t: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, pos, n, x0, x1): the rolling hash after each turn; and (c, block, off, n): the turns before each block."""
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "d0", "d1").rowsBetween(Window.unboundedPreceding, 0)
    own = t.select("c", "block", "turn", "d0", "d1").repartition("c", "block").dropDuplicates()  # the one exchange of digests
    blocks = own.groupBy("c", "block").agg(F.count("*").alias("size"))
    blocks = blocks.select("c", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("off"), F.sum("size").over(Window.partitionBy("c")).alias("n"))
    blocks = scratch.save(blocks, "blocks")
    placed = own.withColumn("in", F.row_number().over(inner)).join(blocks, ["c", "block"]).withColumn("pos", F.col("in") + F.col("off"))
    xor = {x: F.bit_xor(F.xxhash64(F.lit(i), "pos", "d0", "d1")).over(inner) for i, x in enumerate(_LANES)}
    placed = scratch.save(placed.withColumns(xor).select("c", "block", "pos", "n", *_LANES), "placed")
    # only blocks with turns before them need the lanes of those
    ends = placed.groupBy("c", "block").agg(F.max("n").alias("n"), F.count("*").alias("size"), *(F.max_by(x, "pos").alias(x) for x in _LANES)).where("size < n")
    rest = ends.select(F.col("c"), "block", *(F.bit_xor(x).over(before).alias(f"{x}_off") for x in _LANES))
    found = placed.join(rest, ["c", "block"], "left")
    return found.select("c", "pos", "n", *(F.col(x).bitwiseXOR(F.coalesce(f"{x}_off", F.lit(0))).alias(x) for x in _LANES)), blocks


def _maximal(prefixes: DataFrame) -> DataFrame:
    """(c, n_turns, n_logs)."""
    whole = prefixes.where("pos = n").groupBy("pos", *_LANES).agg(F.min("c").alias("c"), F.count("*").alias("n_logs"))
    inner = prefixes.where("pos < n").select("pos", *_LANES).distinct()
    return whole.join(inner, ["pos", *_LANES], "left_anti").select("c", F.col("pos").alias("n_turns"), "n_logs")


def maximal(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation id, n_turns, n_logs): conversations that are no prefix of a longer one.

    A turn logged twice with the same number, role and text counts once; turns of one number are ordered by a hash of
    role and text, and meet in one task. Of equal conversations the least id stays (null before all) and n_logs says how many
    there were. Null ids form one conversation, null numbers come first, null roles and texts are values of their own. An
    empty table gives an empty one; other columns play no part.
    """
    prefixes, _ = _prefixes(_turns(turns, conv, turn, role, text), Scratch(turns.sparkSession, "chat"))
    return _maximal(prefixes).select(F.col("c.id").alias(conv), "n_turns", "n_logs")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conversation id, part, n_turns, n_logs, chat): maximal conversations (as `maximal` says), rendered.

    A turn is `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end; a null role is `unknown`, a null
    text empty. A chat of more than 256 turns comes in several parts (0, 1, ...) whose texts follow one another, so no
    row gathers an unbounded conversation. Other columns are dropped.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    t = _turns(turns, conv, turn, role, text)
    prefixes, blocks = _prefixes(t, scratch)
    kept = scratch.save(_maximal(prefixes).join(blocks.select("c", "block", "off"), "c"), "kept")

    # the lines of a block, cut where the parts of its conversation are; most parts lie within one block
    lines = t.select("c", "block", "turn", "d0", "d1", "line").repartition("c", "block").groupBy("c", "block")
    lines = lines.agg(F.sort_array(F.collect_set(F.struct("turn", "d0", "d1", "line"))).alias("lines"))
    cut = lines.join(kept, ["c", "block"])
    end = F.col("off") + F.size("lines")
    first = lambda p: F.greatest(p * part_turns, F.col("off"))
    size = lambda p: F.least((p + 1) * part_turns, end) - first(p)
    chat = lambda p: F.concat_ws("", F.transform(F.slice("lines", (first(p) - F.col("off") + 1).cast("int"), size(p).cast("int")), lambda x: x["line"]))
    parts = F.sequence(F.floor(F.col("off") / part_turns), F.floor((end - 1) / part_turns))
    piece = F.transform(parts, lambda p: F.struct(p.alias("part"), first(p).alias("first"), size(p).alias("size"), chat(p).alias("chat")))
    cut = cut.select("c", "n_turns", "n_logs", F.explode_outer(piece).alias("p")).select("c", "n_turns", "n_logs", "p.*")
    whole = F.col("size") == F.least(F.lit(part_turns), F.col("n_turns") - F.col("part") * part_turns)
    columns = ["c", "part", "n_turns", "n_logs", "chat"]
    broken = cut.where(~whole).groupBy("c", "part", "n_turns", "n_logs")
    broken = broken.agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("first", "chat"))), lambda x: x["chat"])).alias("chat"))
    return cut.where(whole).select(*columns).unionByName(broken.select(*columns)).withColumn("c", F.col("c.id")).withColumnRenamed("c", conv)


ORACLE_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
     p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                  string_agg(coalesce(role, chr(1)) || chr(31) || coalesce(text, chr(1)), chr(30)) OVER w AS prefix
           FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
     whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_logs FROM p WHERE pos = n GROUP BY prefix),
     kept AS (SELECT conv_id, n_logs FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < n))
SELECT conv_id, CAST((pos - 1) // 256 AS BIGINT) AS part, CAST(max(n) AS BIGINT) AS n_turns, CAST(max(n_logs) AS BIGINT) AS n_logs,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM p JOIN kept USING (conv_id) GROUP BY conv_id, (pos - 1) // 256
"""
