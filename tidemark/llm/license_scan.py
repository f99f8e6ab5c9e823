"""Licence scan by MinHash bands over text windows, in DataFrame operations only.

Windows overlap: one for each place and template length. The MinHash bands of a window retrieve templates; with 16 bands of 2 a
window of Jaccard similarity 2/3 (the least that a containment of 0.8 leaves) meets its template with probability over 0.9999.
Exact containment of the template's shingles decides. A window can share a band with a template only if it holds shingles of
it, so bands are computed for the windows that a common shingle aligns with the template, and the other windows are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import word_hashes

WIDTH, BANDS, ROWS = 3, 16, 2
CONTAINMENT = (4, 5)
#: Words of all templates up to which their shingles and bands are broadcast (about 100 bytes a word); beyond, they are joined by
#: shuffles.
BROADCAST_WORDS = 200_000

# Licence notices in their usual wording.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved-short": "All rights reserved.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}


def notices(spark: SparkSession) -> DataFrame:
    """(license, notice), without leaving the JVM."""
    pairs = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in NOTICES.items()))
    return spark.range(1).select(F.explode(pairs).alias("n")).select("n.*")


def _shingles(words: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - WIDTH)
    one = lambda p: F.xxhash64(*(F.get(words, p + i) for i in range(WIDTH)))
    return F.when(F.size(words) >= WIDTH, F.transform(starts, one)).otherwise(F.array().cast("array<bigint>"))


def _hashed(i: int):
    return lambda x: F.xxhash64(F.lit(i), x)


def _bands(shingles: Column) -> Column:
    low = [F.array_min(F.transform(shingles, _hashed(i))) for i in range(BANDS * ROWS)]
    return F.array(*(F.xxhash64(F.lit(b), *low[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))


def scan(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", name: str = "license", notice: str = "notice", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(key, text_hash, license, matched long, shingles long, word long): the licences that each text contains.

    A licence is found if a window of its length holds at least 4/5 of the template's distinct shingles. matched is the
    most that a window holds, word the first such window's place (words from 0). Templates of fewer than 3 words and
    null or empty texts match nothing. text_hash (xxhash64 of the text) tells apart rows that share a key, null included;
    repeated rows give one row. Several wordings of one licence give it once, the best one (ties: more shingles, then the first place).
    Texts of any length are read whole, a row at a time; empty tables give an empty one. Other columns are dropped, so their
    names cannot clash.
    """
    cat = templates.select(F.col(name).alias("license"), word_hashes(F.col(notice)).alias("w"))
    cat = cat.withColumn("ts", _shingles(F.col("w"))).where(F.size("ts") > 0).select("license", F.size("w").alias("size"), "ts")
    words = cat.agg(F.sum("size")).first()[0] or 0
    small = F.broadcast if words <= broadcast_words else lambda df: df
    starts = cat.select("size", F.posexplode("ts").alias("j", "shingle"), F.col("ts").alias("all"))
    starts = starts.select("shingle", "j", "size", F.when(F.col("j") > 0, F.get("all", F.col("j") - 1)).alias("before")).distinct()
    by_band = cat.select("license", "size", F.array_distinct("ts").alias("ts"), F.explode(_bands(F.col("ts"))).alias("band"))

    base = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text).cast("string")).alias("th"), word_hashes(F.col(text)).alias("h")).where(F.size("h") >= WIDTH)
    at = base.select("k", "th", "h", F.explode(F.sequence(F.lit(0), F.size("h") - WIDTH)).alias("p"))
    shingle = lambda p: F.xxhash64(*(F.get("h", p + i) for i in range(WIDTH)))
    hits = at.withColumn("shingle", shingle(F.col("p"))).join(small(starts), "shingle")
    # only where a run of the template starts: the word before does not continue it
    run = F.col("before").isNull() | (F.col("p") == 0) | (shingle(F.greatest(F.col("p") - 1, F.lit(0))) != F.col("before"))
    hits = hits.where(run).withColumn("start", F.greatest(F.col("p") - F.col("j"), F.lit(0)))
    windows = hits.select("k", "th", "start", "size", _shingles(F.slice("h", F.col("start") + 1, "size")).alias("ws"))
    windows = windows.withColumn("band", F.explode(_bands(F.col("ws"))))
    found = windows.join(small(by_band), ["band", "size"])
    found = found.withColumn("matched", F.size(F.array_intersect("ts", "ws"))).withColumn("shingles", F.size("ts"))
    num, den = CONTAINMENT
    found = found.where(F.col("matched") * den >= F.col("shingles") * num)
    best = F.max(F.struct("matched", "shingles", (-F.col("start")).alias("back"))).alias("best")
    out = found.groupBy("k", "th", "license").agg(best)
    return out.select(
        F.col("k").alias(key), F.col("th").alias("text_hash"), "license", F.col("best.matched").cast("long").alias("matched"),
        F.col("best.shingles").cast("long").alias("shingles"), (-F.col("best.back")).cast("long").alias("word"),
    )


def oracle_sql() -> str:
    """The same by exact containment in every aligned window, without bands."""
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in NOTICES.items())
    return rf"""
WITH n(license, notice) AS (VALUES {quoted}),
     nt AS (SELECT license, regexp_extract_all(lower(notice), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM n),
     ns AS (SELECT license, len(w) AS size, unnest(list_transform(range(0, len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS s, unnest(range(0, len(w) - 2)) AS j FROM nt),
     tot AS (SELECT license, count(DISTINCT s) AS shingles FROM ns GROUP BY license),
     dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents),
     ds AS (SELECT doc_id, unnest(list_transform(range(0, len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS s, unnest(range(0, len(w) - 2)) AS p FROM dt WHERE len(w) >= 3),
     h AS (SELECT DISTINCT ds.doc_id, ns.license, ns.size, ds.p, ds.s, ns.j FROM ds JOIN ns ON ds.s = ns.s),
     st AS (SELECT DISTINCT doc_id, size, greatest(p - j, 0) AS start FROM h),
     c AS (SELECT st.doc_id, h.license, start, count(DISTINCT h.s) AS matched
           FROM st JOIN h ON st.doc_id = h.doc_id AND st.size = h.size AND h.p BETWEEN st.start AND st.start + st.size - 3
           GROUP BY st.doc_id, h.license, st.size, start),
     ok AS (SELECT doc_id, license, start, matched, shingles FROM c JOIN tot USING (license) WHERE matched * 5 >= shingles * 4)
SELECT doc_id, license, CAST(max(matched) AS BIGINT) AS matched, CAST(max(shingles) AS BIGINT) AS shingles,
       CAST(arg_min(start, struct_pack(a := -matched, b := start)) AS BIGINT) AS word
FROM ok GROUP BY doc_id, license
"""
