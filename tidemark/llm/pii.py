r"""Personal data: patterns, and terms that give protected entities away, in DataFrame operations only.

Four patterns find the protected entities (e-mail, IP, card and phone numbers). Over the whole corpus the operator then
counts, for each entity and each word of the documents that hold it, in how many documents they stand together. A
word discloses an entity as far as their pointwise mutual information reaches the entity's information content:

    disclosure = log(co * N / (df_word * df_entity)) / log(N / df_entity)

Words of a disclosure of REMOVE or more are removed wherever they stand in the documents that hold the entity, those of
GENERALISE or more are replaced by their class: a number, a code of letters and digits, or a word. All four counts are of rows, repeated
ones included. Entities of the same documents have the same counts with every word, so
they are counted as one group. There is no least number of meetings: an entity of one document is the rarest of all, and a word
that no other document holds gives it away in full.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

GENERALISE, REMOVE = 0.8, 0.95
KINDS = ("email", "ip", "card", "phone", "term")

# The required patterns with atomic repetition, and, where a pattern starts with a run, only at the run's start or where
# the last match ended: the same matches, found in linear time and without deep recursion on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’_-]*+"
_BLOCK = 256


def _before(lengths: Column, n: Column) -> Column:
    """Sum of all lengths before each place; in blocks, so that long lists cost no square."""
    add = lambda a, x: a + x
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, _BLOCK), F.lit(0), add))
    inside = lambda i: F.aggregate(F.slice(lengths, (i - i % _BLOCK) + 1, i % _BLOCK), F.lit(0), add)
    whole = lambda i: F.aggregate(F.slice(blocks, 1, F.floor(i / _BLOCK).cast("int")), F.lit(0), add)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: whole(i) + inside(i))


def _places(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Adds the matches of a pattern as array<struct<s,e,v>>, in code points, end exclusive; null without any."""
    found, parts, lens, at = (f"{out}_{x}" for x in ("found", "parts", "lens", "at"))
    df = df.withColumn(found, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    n = F.size(found)
    df = df.withColumn(parts, F.when(n > 0, F.split(F.col(text), pattern, -1)))
    df = df.withColumn(lens, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.length(F.get(parts, i)) + F.length(F.get(found, i)))))
    df = df.withColumn(at, F.when(n > 0, _before(F.col(lens), n)))
    start = lambda i: F.get(at, i) + F.length(F.get(parts, i))
    one = lambda i: F.struct(start(i).alias("s"), (start(i) + F.length(F.get(found, i))).alias("e"), F.get(found, i).alias("v"))
    return df.withColumn(out, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))).drop(found, parts, lens, at)


def _valid(kind: str, match: Column) -> Column:
    v = match["v"]
    if kind == "ip":
        return v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        back = F.reverse(digits)
        twice = lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + twice(i) - F.when(twice(i) > 9, 9).otherwise(0))
        return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))
    return F.lit(True)


def _base(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, th, email, ip, card, phone): text, its hash and the valid spans by kind (null or empty without any)."""
    df = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    for kind, pattern in PATTERNS.items():
        df = _places(df, "t", pattern, kind)
        df = df.withColumn(kind, F.filter(kind, partial(_valid, kind)))
    return df


def _tagged(kind: int, x: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))


def _spans(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(k, th, email, ip, card, phone, ents, t), written: ents names the text's entities, t is null where there are none.

    It is a table because a filter on it would else be pushed below and repeat the patterns for every match."""
    none = F.array().cast("array<struct<kind:int,s:int,e:int,v:string>>")
    df = _base(docs, key, text).withColumn("all", F.concat(*(F.coalesce(F.transform(kind, partial(_tagged, i)), none) for i, kind in enumerate(PATTERNS))))
    value = lambda x: F.when(x["kind"] == 0, F.lower(x["v"])).when(x["kind"] == 1, x["v"]).otherwise(F.regexp_replace(x["v"], "[^0-9]", ""))
    df = df.withColumn("ents", F.array_distinct(F.transform("all", lambda x: F.xxhash64(x["kind"], value(x)))))
    return scratch.save(df.select("k", "th", *PATTERNS, "ents", F.when(F.size("ents") > 0, F.col("t")).alias("t")), "spans")


def _by_document(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    b = b.withColumnsRenamed({"k": "bk", "th": "bth"})
    return a.join(b, F.col("k").eqNullSafe(F.col("bk")) & (F.col("th") == F.col("bth")), how).drop("bk", "bth")


def _terms(text: str) -> Column:
    """The distinct lower-cased words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), F.lower))


def _groups(held: DataFrame) -> DataFrame:
    """(k, th, groups): the groups of entities in each document that holds any, a group being those of the same documents."""
    one = held.select("k", "th", F.explode("ents").alias("ent"), F.xxhash64("k", "th").alias("h"))
    sums = F.sum(F.shiftright("h", 32)).alias("hi"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("lo")
    ents = one.groupBy("ent").agg(F.count("*").alias("df_ent"), *sums)
    ents = ents.select("ent", "df_ent", F.xxhash64("hi", "lo", "df_ent").alias("grp"))
    return one.join(ents, "ent").groupBy("k", "th").agg(F.collect_set(F.struct("grp", "df_ent")).alias("groups"))


def _met(held: DataFrame) -> DataFrame:
    """(k, th, grp, df_ent, term): each word of each document that holds an entity, with the document's groups."""
    both = _by_document(held, _groups(held)).select("k", "th", "groups", F.explode_outer(_terms("t")).alias("term"))
    met = both.where("term IS NOT NULL").select("k", "th", F.explode("groups").alias("g"), "term")
    return met.select("k", "th", "g.grp", "g.df_ent", "term")


def _words(held: DataFrame) -> DataFrame:
    """(k, th, term, s, e): every word of each document; places are running sums, as `_places` suits short lists only."""
    found = F.regexp_extract_all(F.col("t"), F.lit(TERM), F.lit(0))
    both = F.arrays_zip(F.split("t", TERM, -1).alias("part"), found.alias("word"))
    rows = held.select("k", "th", "t").dropDuplicates(["k", "th"]).select("k", "th", F.posexplode_outer(both).alias("i", "x"))
    size = F.coalesce(F.length("x.word"), F.lit(0))
    end = F.sum(F.length("x.part") + size).over(Window.partitionBy("k", "th").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("k", "th", F.lower("x.word").alias("term"), (end - size).cast("int").alias("s"), end.cast("int").alias("e"))


def disclosures(docs: DataFrame, met: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(grp, term, disclosure) of the words that disclose a group's entities, over the whole corpus."""
    counts = met.groupBy("grp", "df_ent", "term").agg(F.count("*").alias("co"))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    df_term = rows.select(F.explode_outer(_terms("t")).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df_term"))
    found = counts.join(df_term, "term").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row
    content = F.log(F.col("n") / F.col("df_ent"))
    pmi = F.log(F.col("co") * F.col("n") / (F.col("df_term") * F.col("df_ent")))
    found = found.where(F.col("df_ent") < F.col("n")).withColumn("disclosure", pmi / content)
    return found.where(F.col("disclosure") >= GENERALISE).select("grp", "term", "disclosure")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, email, ip, card, phone, terms): the spans of every whole text, a row for each input row.

    The pattern kinds are array<struct<s,e,v>>, terms array<struct<s,e,remove>>, all in order, in code points from 0, end
    exclusive; null or empty where there are none. Null texts count as empty. Documents of equal key and text share their
    spans; null keys are rows like others. Texts of any length are read whole; a word of equal disclosure for several entities takes
    the highest; an empty table gives an empty one. Other columns are dropped, so their names cannot clash.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    spans = _spans(docs, key, text, scratch)
    held = spans.where("t IS NOT NULL").select("k", "th", "ents", "t")
    met = scratch.save(_met(held), "met")
    found = disclosures(docs, met, key, text)
    hit = scratch.save(met.join(found, ["grp", "term"]).groupBy("k", "th", "term").agg((F.max("disclosure") >= REMOVE).alias("remove")), "hit")
    words = _words(held).where("term IS NOT NULL")
    marked = _by_document(words, hit.withColumnRenamed("term", "of")).where("term = of")
    terms = marked.groupBy("k", "th").agg(F.array_sort(F.collect_set(F.struct("s", "e", "remove"))).alias("terms"))
    out = _by_document(spans.drop("ents", "t"), terms, "left")
    inside = lambda kind, w: F.coalesce(F.exists(kind, lambda x: (x["s"] < w["e"]) & (x["e"] > w["s"])), F.lit(False))
    apart = lambda w: ~(inside("email", w) | inside("ip", w) | inside("card", w) | inside("phone", w))
    return out.withColumn("terms", F.filter("terms", apart)).withColumnsRenamed({"k": key, "th": "text_hash"})


def span_text(kinds: dict[str, str]) -> Column:
    """kind:start:end of all spans, by kind as given and then by start, joined by commas; kinds: name -> column."""
    none = F.array().cast("array<string>")
    one = lambda name: lambda x: F.concat(F.lit(f"{name}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
    return F.concat_ws(",", F.concat(*(F.coalesce(F.transform(c, one(name)), none) for name, c in kinds.items())))


def _labelled(label: Column, x: Column) -> Column:
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), label.alias("label"))


def _class(word: Column) -> Column:
    """What a generalised word becomes: the class that it shares with many others."""
    return F.when(word.rlike(r"^\p{N}+$"), "[NUMBER]").when(word.rlike(r"\p{N}"), "[CODE]").otherwise("[WORD]")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns and personal data replaced in `text`: [EMAIL], [IP], [CARD], [PHONE],
    [REMOVED] for disclosing words, and for generalised ones their class [NUMBER], [CODE] or [WORD]. Overlapping spans are replaced as
    one run. Rows, null texts and repeated rows stay as they are, one for one."""
    found = find(docs, key, text)
    sk, sth, name = fresh(docs, "found_key", "found_hash", "found_spans")
    none = F.array().cast("array<struct<s:int,e:int,label:string>>")
    pieces = [F.coalesce(F.transform(kind, partial(_labelled, F.lit(f"[{kind.upper()}]"))), none) for kind in PATTERNS]
    pieces.append(F.coalesce(F.transform("terms", lambda x: _labelled(F.when(x["remove"], "[REMOVED]"), x)), none))  # a null label: the class
    spans = found.select(F.col(key).alias(sk), F.col("text_hash").alias(sth), F.array_sort(F.concat(*pieces)).alias(name))
    spans = spans.where(F.size(name) > 0).distinct()
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1)["e"], F.lit(0))
    rest = lambda a, x: F.struct(F.greatest(x["s"], last(a)).alias("s"), x["e"].alias("e"), x["label"].alias("label"))
    apart = F.aggregate(name, none, lambda a, x: F.when(x["e"] > last(a), F.concat(a, F.array(rest(a, x)))).otherwise(a))
    spans = spans.withColumn(name, apart)
    same = docs[key].eqNullSafe(spans[sk]) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == spans[sth])
    df = docs.join(spans, same, "left")
    n = F.size(name)
    before = lambda i: F.when(i > 0, F.get(name, i - 1)["e"]).otherwise(0)
    cut = lambda frm, to: F.substring(F.col(text), frm + 1, to - frm)
    label = lambda x: F.coalesce(x["label"], _class(cut(x["s"], x["e"])))
    one = lambda i: F.concat(cut(before(i), F.get(name, i)["s"]), label(F.get(name, i)))
    kept = F.concat(F.concat_ws("", F.transform(F.sequence(F.lit(0), n - 1), one)), cut(before(n), F.length(text)))
    return df.withColumn(text, F.when(n > 0, kept).otherwise(F.col(text))).drop(sk, sth, name)
