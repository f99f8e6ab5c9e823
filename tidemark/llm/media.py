"""Media columns: content-addressed payloads in tar shards.

Writing packs each distinct payload of a task once into a tar shard as a PNG of 8-bit grey samples, 64 a row, and
leaves one index row per document: digest, shard, offset and length of the PNG inside the shard. Reading takes the PNG's
first 33 bytes by a range read for the metadata columns and the rest only where samples are asked for.

Shards get their final name when they are complete, and a new name in each attempt of a task, so a lost executor leaves
at most files that no index row names.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WIDTH = 64
#: Bytes at which a shard is closed and the next one begun; also bounds the digests that a task remembers.
SHARD_BYTES = 256 << 20
HEADER = 33  # signature and IHDR chunk
SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "digest binary, shard string, offset long, length long, n_bytes long"


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def png_samples(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, packed = HEADER, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """8 x 8 average hash, mean level and entropy of the samples."""
    a = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    edges = np.arange(9) * len(a) // 8
    # sums over 8 bands of rows and 8 of columns; images under 8 rows repeat rows
    total = np.vstack([np.zeros((1, WIDTH), np.int64), np.cumsum(a, axis=0, dtype=np.int64)])
    lo, hi = np.minimum(edges[:-1], len(a) - 1), np.maximum(edges[1:], np.minimum(edges[:-1], len(a) - 1) + 1)
    cells = (total[hi] - total[lo]).reshape(8, 8, 8).sum(axis=2) / (hi - lo)[:, None]
    bits = (cells > cells.mean()).ravel()
    p = np.bincount(a.ravel(), minlength=256) / a.size
    p = p[p > 0]
    return f"{int.from_bytes(np.packbits(bits).tobytes()):016x}:{a.mean():.3f}:{float(-(p * np.log2(p)).sum()):.4f}"


class _Shard:
    def __init__(self, root: str):
        self.uri = f"{root}/{uuid.uuid4().hex}.tar"
        self.files, self.path = fs.FileSystem.from_uri(self.uri)
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.files.open_output_stream(self.path + ".part")
        self.at, self.seen = 0, {}

    def add(self, digest: bytes, media: bytes) -> tuple:
        if digest not in self.seen:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + media + bytes(-len(media) % 512))
            self.seen[digest] = (digest, self.uri, self.at + len(head), len(media))
            self.at += len(head) + len(media) + -len(media) % 512
        return self.seen[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        self.files.move(self.path + ".part", self.path)


def write_media(df: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packs every whole text into tar shards under the scratch folder and returns the index.

    Index: (key, digest binary, shard, offset, length, n_bytes), a row for each input row. Null and empty texts
    are payloads of 64 zero bytes. Equal payloads have one digest; all their rows name the same first location, and a
    shard holds a payload once however often it is repeated. Other columns are dropped.
    """
    rows, index = _write(df, scratch, key, text, shard_bytes)
    return rows.join(_first(index), "digest").select(key, "digest", "shard", "offset", "length", "n_bytes")


def _first(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): each payload's first location."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _write(df: DataFrame, scratch: Scratch, key: str, text: str, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(key, digest, n_bytes) and (digest, shard, offset, length) of each row, the location being that in its task's shard."""
    root = scratch.path("shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept = None, []

        def flush() -> pa.RecordBatch:
            keys = pa.array([k for k, _ in kept], ktype)
            cols = list(zip(*(r for _, r in kept)))
            kinds = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["k", "digest", "shard", "offset", "length", "n_bytes"])
            kept.clear()
            return out

        for batch in batches:
            ktype = batch.schema.field(0).type
            for k, t in zip(batch.column(0), batch.column(1)):
                data = (t.as_py() or "").encode()
                payload = pad(data)
                shard = shard or _Shard(root)
                digest = hashlib.sha256(payload).digest()
                row = shard.seen.get(digest) or shard.add(digest, to_png(payload))
                kept.append((k.as_py(), (*row, len(data))))
                if shard.at >= shard_bytes:
                    shard.close()
                    shard = None
            # rows of a shard that is still open wait: an index row names a complete shard only
            if shard is None and kept:
                yield flush()
        if shard is not None:
            shard.close()
        if kept:
            yield flush()

    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    index = scratch.save(src.mapInArrow(run, f"k {kind}, {INDEX}"), "index")
    return index.select(F.col("k").alias(key), "digest", "n_bytes"), index.select("digest", "shard", "offset", "length")


def _members(index: DataFrame) -> DataFrame:
    """Each stored payload once, those of a shard together and in order."""
    return index.select("digest", "shard", "offset", "length").distinct().repartition("shard").sortWithinPartitions("shard", "offset")


def _ranges(files: dict, uri: str):
    if uri not in files:
        for f in files.values():
            f.close()
        files.clear()
        source, path = fs.FileSystem.from_uri(uri)
        files[uri] = source.open_input_file(path)
    return files[uri]


def read_metadata(index: DataFrame) -> DataFrame:
    """(digest, width, height, payload_bytes) from header-only range reads: 33 bytes a payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for b in batches:
            heads = [png_header(_ranges(files, r["shard"]).read_at(HEADER, r["offset"])) for r in b.select(["shard", "offset"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), *(pa.array(c, pa.int64()) for c in ([h[0] for h in heads], [h[1] for h in heads], [h[0] * h[1] for h in heads]))], names=["digest", "width", "height", "payload_bytes"])

    return _members(index).mapInArrow(run, "digest binary, width long, height long, payload_bytes long")


def read_features(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length, payload_bytes, tail_crc32, media_digest, feature) from the stored bytes.

    payload_bytes comes from the header; the samples are hashed anew, and a mismatch with their address raises, so digest
    is also what was read back.
    """

    def one(files: dict, r: dict) -> tuple:
        f = _ranges(files, r["shard"])
        width, height, _ = png_header(f.read_at(HEADER, r["offset"]))
        media = f.read_at(r["length"], r["offset"])
        samples = png_samples(media)
        if hashlib.sha256(samples).digest() != r["digest"] or len(samples) != width * height:
            raise ValueError(f"{r['shard']} is damaged at {r['offset']}")
        return width * height, zlib.crc32(samples[-WIDTH:]), hashlib.sha256(media).digest(), feature(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        names = [*("digest", "shard", "offset", "length"), "payload_bytes", "tail_crc32", "media_digest", "feature"]
        for b in batches:
            if b.num_rows:
                rows = [one(files, r) for r in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

    return _members(index).mapInArrow(run, "digest binary, shard string, offset long, length long, payload_bytes long, tail_crc32 long, media_digest binary, feature string")


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, shard, offset, length, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature):
    stores every text and returns, a row for each input row, its location and what the stored bytes say about it.

    Null and empty texts are payloads of 64 zero bytes; equal payloads share all values; repeated rows and null keys are rows
    like others; an empty table gives an empty one. Other columns are dropped, so their names cannot clash.
    """
    scratch = Scratch(df.sparkSession, "media")
    rows, index = _write(df, scratch, key, text, SHARD_BYTES)
    # one join of the rows with all that is known of a payload: a digest that many rows share can be split. Digests stay
    # binary until the end, and the location rides along with the read instead of being joined to it again.
    known = scratch.save(read_features(_first(index)), "known")
    hexed = lambda c: F.lower(F.hex(c))
    return rows.join(known, "digest").select(
        key, "n_bytes", "shard", "offset", "length", "payload_bytes", hexed("digest").alias("payload_sha256"), "tail_crc32",
        F.col("length").alias("media_bytes"), hexed("media_digest").alias("media_sha256"), "feature",
    )
