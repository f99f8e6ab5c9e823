"""Listings of media files and batches as DataFrames (path, name, ...), and readers of what other tools leave."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import batch_date, natural_key


def files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, name, modified, size) without reading the files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def media(listing: DataFrame, exts: Sequence[str]) -> DataFrame:
    """Visible files with one of the extensions, with a key for natural order."""
    ok = ~F.col("name").startswith(".") & extension(F.col("name")).isin(*exts)
    return listing.where(ok).withColumn("natural", natural_key(F.col("name")))


def batches(names: DataFrame, order: str = "DMY", skip: Sequence[str] = (), name: str = "name") -> DataFrame:
    """Names that begin with a date, without those that hold a word to skip; the newest first is orderBy(date, path desc)."""
    df = names.withColumn("date", batch_date(F.col(name), order)).where("date IS NOT NULL")
    for word in skip:
        df = df.where(~F.lower(name).contains(word.lower()))
    return df


def candidates(listing: DataFrame, words: Sequence[str], exts: Sequence[str], path: str = "path") -> DataFrame:
    """Files whose path, in lower case and with runs of space, _ and - as one space, holds all the words."""
    flat = F.regexp_replace(F.lower(path), r"[\s_-]+", " ")
    df = listing.where(extension(F.col(path)).isin(*exts))
    for w in words:
        df = df.where(flat.contains(w.lower()))
    return df


def library(listing: DataFrame, prefix: str, exts: Sequence[str], ban: Sequence[str], name: str = "name") -> DataFrame:
    df = listing.where(F.col(name).startswith(prefix) & extension(F.col(name)).isin(*exts))
    for b in ban:
        df = df.where(~F.lower(name).contains(b.lower()))
    return df


def find_image(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(want, path): for each wanted name the file of that name, else in any case, else of its stem, PNG first."""
    stem = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]*$", ""))
    f = listing.select("path", "name", stem(F.col("name")).alias("stem"))
    both = wanted.select("want", stem(F.col("want")).alias("stem")).join(f, "stem")
    rank = F.when(F.col("name") == F.col("want"), 0).when(F.lower("name") == F.lower("want"), 1).when(extension(F.col("name")) == ".png", 2).otherwise(3)
    return both.groupBy("want").agg(F.min_by("path", F.struct(rank, "name")).alias("path"))


def newest(listing: DataFrame, pattern: str) -> DataFrame:
    return listing.where(F.col("name").rlike(pattern)).orderBy(F.col("modified").desc(), "path").limit(1)


def wav_frames(spark: SparkSession, path: str, hop_seconds: float = 0.02) -> DataFrame:
    """(path, channel, i, ms, rate): mean square of each whole hop of 16-bit WAV files, channel by channel."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for file, data in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(data)) as w:
                    rate, n = w.getframerate(), w.getnchannels()
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, n) / 32768.0
                hop = int(rate * hop_seconds)
                ms = (x[: len(x) // hop * hop].reshape(-1, hop, n) ** 2).mean(axis=1)
                for c in range(n):
                    yield pd.DataFrame({"path": file, "channel": c, "i": np.arange(len(ms)), "ms": ms[:, c], "rate": rate})

    df = spark.read.format("binaryFile").load(path).select("path", "content")
    return df.mapInPandas(run, "path string, channel int, i long, ms double, rate int")


def words_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, engine, idx, s, e, t, p, src, spk) of cached word files; missing fields take their defaults."""
    schema = "engine string, words array<struct<s: double, e: double, t: string, p: double, src: string, spk: string>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("path"), "engine", F.posexplode("words").alias("idx", "w"))
    fill = {"p": 1.0, "src": "a", "spk": "", "t": ""}
    return df.select("path", "engine", "idx", "w.s", "w.e", *(F.coalesce(f"w.{c}", F.lit(v)).alias(c) for c, v in fill.items()))


def words_or_islands(words: DataFrame, islands: DataFrame, key: Sequence[str]) -> DataFrame:
    """The words of each key, and where a key has none its islands of sound as words without text."""
    rest = islands.join(words.select(*key).distinct(), list(key), "left_anti")
    return words.select(*key, "s", "e", "t").unionByName(rest.select(*key, "s", "e", F.lit("").alias("t")))


def samples_long(samples: DataFrame, key: Sequence[str]) -> DataFrame:
    """Nested samples (key, t, faces array<struct>) as rows (key, t, face, fields)."""
    return samples.select(*key, "t", F.posexplode("faces").alias("face", "f")).select(*key, "t", "face", "f.*")


def samples_nested(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    fields = [c for c in rows.columns if c not in (*key, "t", "face")]
    packed = F.array_sort(F.collect_list(F.struct("face", *fields)))
    return rows.groupBy(*key, "t").agg(F.transform(packed, lambda x: F.struct(*(x[c].alias(c) for c in fields))).alias("faces"))
