import hashlib
import tarfile
import zlib

from pyarrow import fs

from tidemark.llm import entry, media
from tidemark.llm.common import Scratch

ROWS = [(1, "héllo", 0), (2, "héllo", 0), (3, "", 0), (4, None, 0), (5, "x" * 64, 0), (6, "y" * 65, 0), (7, "long " * 30000, 0), (None, "héllo", 0)]


def test_png_round_trip():
    for t in ("", "a", "b" * 64, "c" * 1000):
        data = media.pad(t.encode())
        png = media.to_png(data)
        assert media.png_header(png[:33])[:2] == (64, len(data) // 64) and media.png_samples(png) == data


def test_stored_bytes_come_back(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, digest int")
    got = {(r.doc_id, r.n_bytes): r for r in media.media_columns(df).collect()}
    assert len(got) == len(ROWS)
    for k, t, _ in ROWS:
        payload = media.pad((t or "").encode())
        r = got[k, len((t or "").encode())]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_png(payload)).hexdigest() and r.media_bytes == len(media.to_png(payload))
    assert got[1, 6].feature == got[2, 6].feature and got[1, 6].shard == got[2, 6].shard and got[1, 6].offset == got[2, 6].offset
    assert media.media_columns(df.limit(0)).collect() == []


def test_shards_are_tar_files_of_limited_size_and_headers_are_enough(spark):
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string").coalesce(1)
    index = media.write_media(df, Scratch(spark, "t"), shard_bytes=4096)
    shards = {r.shard for r in index.collect()}
    assert len(shards) > 3
    names = []
    for s in shards:
        files, path = fs.FileSystem.from_uri(s)
        with tarfile.open(fileobj=files.open_input_file(path)) as tar:
            names += [m.name for m in tar.getmembers()]
    assert sorted(names) == sorted({bytes(r.digest).hex() + ".png" for r in index.collect()})
    sizes = {bytes(r.digest): r.payload_bytes for r in media.read_metadata(index).collect()}
    assert sizes == {hashlib.sha256(media.pad(f"text {i} ".encode() * 50)).digest(): len(media.pad(f"text {i} ".encode() * 50)) for i in range(40)}


def test_query(spark):
    rows = entry.op10_media_columns(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.payload_bytes % 64 == 0 and r.payload_bytes >= r.n_bytes for r in rows)
