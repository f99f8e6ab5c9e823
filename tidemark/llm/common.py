"""Shared plumbing of the training-data operators: scratch tables in the cluster's shared folder, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest value, in bytes, that any operator here hands to every executor.
MAX_BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one in local tests only."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor rereads them and recomputes nothing above.

    `drop` removes a table that no later step reads, with its folder; `sweep` removes all of them once the result has been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        for folder in {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}:
            self._delete(folder)

    def sweep(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as the table's columns require (case aside, as Spark compares)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def read_driver_file(path: str) -> bytes:
    """A small file on the driver (a vocabulary), refused beyond the broadcast bound."""
    with open(path, "rb") as f:
        data = f.read(MAX_BROADCAST_BYTES + 1)
    if len(data) > MAX_BROADCAST_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BROADCAST_BYTES} bytes")
    return data


def word_hashes(text):
    """64-bit hashes of the lower-cased runs of letters, marks and digits of a text column; empty for null."""
    from pyspark.sql import functions as F

    found = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def chunks(batches, most: int):
    """Keys and texts (null as empty) of (key, text) batches, in runs of at most `most` bytes of text or one row."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        sizes = [len(t.as_buffer() or b"") for t in texts]
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield keys.slice(begin, i - begin), [t or "" for t in texts.slice(begin, i - begin).to_pylist()]
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield keys.slice(begin), [t or "" for t in texts.slice(begin).to_pylist()]
