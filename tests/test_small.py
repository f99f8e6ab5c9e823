"""Listings, cached words, nested samples, sprites, sound levels and bands, proposals and tables for reading."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules, selection, signals, timeline
from tidemark.sources import media, sinks

K = ["short"]


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def test_listings(make):
    names = make([("29:09:26 Lian",), ("2026-09-30 old test",), ("notes",)], "name string")
    assert [(r.name, str(r.date)) for r in media.batches(names, skip=["TEST"]).collect()] == [("29:09:26 Lian", "2026-09-29")]
    files = make([("/m/a.png", "a.png"), ("/m/A.jpg", "A.jpg"), ("/m/b.JPG", "b.JPG"), ("/m/x_1.mp3", "x_1.mp3"), ("/m/x_live.mp3", "x_live.mp3")], "path string, name string")
    found = {r.want: r.path for r in media.find_image(files, make([("a.webp",), ("B.jpg",), ("A.jpg",), ("none.png",)], "want string")).collect()}
    assert found == {"a.webp": "/m/a.png", "B.jpg": "/m/b.JPG", "A.jpg": "/m/A.jpg"}
    assert [r.name for r in media.library(files, "x", [".mp3"], ["LIVE"]).collect()] == ["x_1.mp3"]
    aged = make([("/a", "s1.mov", 1), ("/b", "s2.mov", 3), ("/c", "s3.mov", 3), ("/d", "t.mov", 9)], "path string, name string, modified int")
    assert [r.path for r in media.newest(aged, r"^s\d").collect()] == ["/b"] and media.newest(aged, "zzz").count() == 0


def test_cached_words_and_islands(spark, make, tmp_path):
    (tmp_path / "w.json").write_text('{"engine": "x", "words": [{"s": 1.0, "e": 1.5, "t": "hi"}, {"s": 2.0, "e": 2.5, "p": 0.5, "spk": "H"}]}')
    got = media.words_json(spark, str(tmp_path / "w.json")).orderBy("idx").collect()
    assert [(r.idx, r.s, r.t, r.p, r.src, r.spk) for r in got] == [(0, 1.0, "hi", 1.0, "a", ""), (1, 2.0, "", 0.5, "a", "H")]
    w = make([("a", 1.0, 2.0, "x")], "short string, s double, e double, t string")
    i = make([("a", 5.0, 6.0), ("b", 7.0, 8.0)], "short string, s double, e double")
    assert sorted(map(tuple, media.words_or_islands(w, i, K).collect())) == [("a", 1.0, 2.0, "x"), ("b", 7.0, 8.0, "")]


def test_samples_there_and_back(make):
    nested = make([("a", 0.2, [(1.0, 2.0), (3.0, 4.0)]), ("a", 0.4, [(5.0, 6.0)])], "short string, t double, faces array<struct<x: double, y: double>>")
    rows = media.samples_long(nested, K)
    assert sorted((r.t, r.face, r.x) for r in rows.collect()) == [(0.2, 0, 1.0), (0.2, 1, 3.0), (0.4, 0, 5.0)]
    assert sorted(map(tuple, media.samples_nested(rows, K).collect())) == sorted(map(tuple, nested.collect()))


def test_sprite_comes_stays_and_goes(make):
    dy, alpha = timeline.animation(F.col("t"), 3.0, 0.5, 0.5, 400.0, 100.0)
    got = make([(t,) for t in (0.0, 0.5, 1.5, 3.0, 9.0)], "t double").select(dy.alias("dy"), alpha.alias("a")).collect()
    assert [round(r.dy, 6) for r in got] == [400, 0, 0, 100, 100] and [r.a for r in got] == [1, 1, 1, 0, 0]
    over = make([(0.35,)], "t double").select(dy).first()[0]
    assert over < 0  # past its place before it settles


def test_levels_and_bands(make):
    loud = [0.5] * 40 + [0.05] * 20 + [0.5]
    x = make([("a", n, v) for n, v in enumerate(loud)], "short string, n int, x double")
    got = {r.i: r.db for r in signals.energy_db(x, K, 10).collect()}
    assert len(got) == 6 and all(abs(got[i]) < 1e-9 for i in range(4)) and all(got[i] == pytest.approx(20 * math.log10((0.05 + 1e-9) / (0.5 + 1e-9))) for i in (4, 5))
    b = make([("a", n, v) for n, v in enumerate([8.0, 0.0, 4.0, -40.0])], "short string, band int, g double")
    assert [r.o for r in signals.smooth_bands(b, K, "g", "o", 6.0).orderBy("band").collect()] == [6.0, 3.0, -6.0, -6.0]
    assert np.allclose([6.0, 3.0], [min(6, 0.25 * 8 + 0.5 * 8), 0.25 * 8 + 0.25 * 4])


def test_proposals(make):
    words = make([("a", i, i * 1.0, i + 0.8) for i in range(10)], "short string, idx int, s double, e double")
    kept = make([("a", 0.0, 10.0)], "short string, s double, e double")
    p = lambda *rows: rules.accept_proposals(make([("a", *r) for r in rows], "short string, start int, end int, reason string"), words, kept, K)
    assert [(r.s, r.e, r.reason) for r in p((2, 4, "unclear"), (30, 40, "none")).collect()] == [(2.0, 4.8, "unclear")]
    assert p((0, 9, "all")).count() == 0
    cuts = make([("a", 2.0, 4.8, "x")], "short string, s double, e double, reason string")
    assert [r.idx for r in rules.live_words(words, cuts, K, 0.01).orderBy("idx").collect()] == [0, 1, 5, 6, 7, 8, 9]


def test_counts_names_and_reading(make):
    n = make([(0.5,), (1.0,), (3.1,), (8.0,)], "w double").select(selection.cut_count(F.col("w"), 1.0, 2.0))
    assert [r[0] for r in n.collect()] == [1, 1, 2, 5]
    taken = make([("Batch 2",), ("Batch 11",), ("Batch x",), ("Other 40",)], "name string")
    assert selection.next_name(taken, "Batch").first().name == "Batch 12" and selection.next_name(taken.limit(0), "Batch").first().name == "Batch 1"
    assert sinks.markdown(make([("b", 2), ("a", 1)], "name string, n int")) == "| name | n |\n| --- | --- |\n| a | 1 |\n| b | 2 |"


def test_covered_captions_go(make):
    c = make([("a", 1.0, 2.0), ("a", 2.5, 4.0), ("b", 1.0, 2.0)], "short string, s double, e double")
    o = make([("a", 0.5, 2.0), ("a", 3.0, 9.0)], "short string, s double, e double")
    assert sorted(map(tuple, sinks.without_covered(c, o, K).collect())) == [("a", 2.5, 4.0), ("b", 1.0, 2.0)]
