"""Framing, turns, stages and the small selections: fixed results and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import angles, selection, signals, timeline
from tidemark.plans import stages
from tidemark.sources import sinks

K = ["short"]
FACE = "struct<cx: double, ey: double, w: double>"
PIECES = "short string, pos int, s double, e double, spk string"


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def framed(make, pieces, samples):
    p = make([("a", i, float(s), float(e), spk) for i, (s, e, spk) in enumerate(pieces)], PIECES)
    f = make([("a", float(t), h, g) for t, h, g in samples], f"short string, t double, H {FACE}, G {FACE}")
    return angles.frame_pieces(p, f, K, timeline.Canvas(), 3840.0, 2160.0)


H, G = (910.0, 680.0, 220.0), (2710.0, 680.0, 220.0)
TIMES = np.arange(0, 12, 0.2)


def test_speakers_are_centred(make):
    rows = framed(make, [(0, 4, "G"), (4, 7, "H"), (7, 9, "G"), (9, 12, "")], [(t, H, G) for t in TIMES]).orderBy("pos").collect()
    assert [r.who for r in rows] == ["G", "H", "G", "H"] and not any(r.flags for r in rows) and len({r.zoom for r in rows}) == 1
    assert rows[1].pan > rows[0].pan == rows[2].pan and [(r.s, r.e) for r in rows] == [(0, 4), (4, 7), (7, 9), (9, 12)]
    z = rows[0].zoom
    assert rows[0].pan == round(min(max(540 - (2710 - 1920) * z, 1080 - 1920 * z + 3), 1920 * z - 3) - 540, 1)


def test_without_a_face(make):
    samples = [(t, None if t > 3.9 else H, G if t < 8 else None) for t in TIMES]
    df = framed(make, [(0, 3.8, "H"), (4, 7, "H"), (8, 8.5, "H"), (9, 12, "H")], samples)
    rows = df.orderBy("pos").collect()
    assert [r.who for r in rows] == ["H", "G", "G", ""] and [r.flags for r in rows] == [[], [], [], ["bad_angle"]]
    assert rows[1].note == angles.OTHER and rows[2].note == angles.TINY and rows[2].pan == rows[1].pan and rows[3].note == angles.COVER % (0, 0)
    assert [(r.t, r.name) for r in angles.angle_markers(df, K).collect()] == [(9.0, angles.BAD_NAME)]


def test_moving_head_is_cut_into_steady_parts(make):
    samples = [(t, (1200.0 if t < 6 else 2400.0, 700.0, 220.0), None) for t in TIMES]
    df = framed(make, [(0, 12, "H")], samples)
    rows = df.orderBy("part").collect()
    assert len(rows) > 1 and all("stab" in r.flags for r in rows) and rows[0].s == 0 and rows[-1].e == 12
    assert all(a.e == b.s for a, b in zip(rows, rows[1:])) and rows[0].pan > rows[-1].pan
    assert [r.name for r in angles.angle_markers(df, K).where("color = 'Green'").collect()] == [angles.STAB_NAME]
    assert framed(make, [(0, 12, "H")], samples).where("part < 0").count() == 0


def test_turns_begin_at_their_sound(make):
    level = np.full(500, -45.0)
    for a, b in ((50, 100), (195, 260), (300, 360)):
        level[a:b] = 0
    heard = signals.sound(make([("a", i, float(x)) for i, x in enumerate(level)], "short string, i int, db double"), K)
    words = make([("a", 0, 1.0, 2.0), ("a", 1, 4.0, 5.2), ("a", 2, 6.0, 7.2)], "short string, idx int, s double, e double")
    sents = make([("a", 0, 1.0, 0), ("a", 1, 4.0, 1), ("a", 2, 6.0, 2)], "short string, sent int, s double, first int")
    spoken = make([("a", 1.0, 2.0, "H"), ("a", 4.0, 5.2, "G"), ("a", 6.0, 7.2, "H"), ("a", 9.0, 9.5, "G")], "short string, s double, e double, spk string")
    got = [r.t for r in angles.turn_cuts(spoken, words, sents, heard, K, 25.0).orderBy("t").collect()]
    assert got == pytest.approx([3.9 - 0.08, 6.0 - 0.08], abs=0.045) and len(got) == 2


def test_rough_stage(make):
    rnd = random.Random(3)
    words = make([("a", 3.0, 3.4), ("a", 3.5, 4.0), ("a", 7.0, 7.5)], "short string, s double, e double")
    shorts = make([("a", 12.0, 30.0), ("silent", 5.0, 30.0)], "short string, duration double, fps double")
    frames = make([("a", i, 0.0 if any(a <= i / 50 < b for a, b in ((3, 4), (7, 7.5))) else -45.0 - rnd.random()) for i in range(600)], "short string, i int, db double")
    cuts = [tuple(r)[1:] for r in stages.rough_cuts(words, frames, shorts, K).orderBy("s").collect()]
    assert [c[2] for c in cuts] == ["head", "gap", "tail"] and np.allclose([c[:2] for c in cuts], [(0, 2.85), (4.25, 6.85), (7.75, 12)], atol=0.03)
    pieces, protect = stages.rough(words, frames, shorts, K, 30.0)
    got = [(r.short, r.pos, r.flags) for r in pieces.orderBy("short", "pos").collect()]
    assert got == [("a", 0, []), ("a", 1, ["phone"]), ("a", 2, []), ("silent", 0, [])] and protect.count() == 1
    plain, none = stages.rough(words, frames, shorts, K, 30.0, review=False)
    assert plain.where("short = 'a'").count() == 2 and none.count() == 0
    left = stages.fine(plain.where("short = 'a'"), make([("a", 3.2, 3.6)], "short string, s double, e double"), K, 30.0)
    assert [r.pos for r in left.orderBy("pos").collect()] == [0, 1, 2]


def test_names_windows_widths_and_flags(make):
    taken = make([("One",), ("One v2",), ("One v4",), ("Two v2",)], "name string")
    got = {r.name: r.free for r in selection.unique_name(taken, make([("One",), ("Two",), ("Two v2",)], "name string")).collect()}
    assert got == {"One": "One v3", "Two": "Two", "Two v2": "Two v2 v2"}
    slots = make([("a", 1.0, 1.1, "H", 9.0), ("a", 3.0, 3.1, "H", 9.0), ("a", 3.5, 3.6, "H", 9.0), ("a", 7.5, 7.6, "H", 9.0), ("a", 20.0, 20.1, "", 20.0)], "short string, t_in double, mention double, who string, stay double")
    assert [(r.f_a, r.f_b) for r in selection.behind_windows(slots, K, 10.0, 3.0, 2.0).orderBy("f_a").collect()] == [(10, 30), (35, 65)]
    w = make([(1000, 50.0), (9000, 50.0), (100, 50.0)], "w int, scale double").select(selection.shown_width(F.col("w"), F.col("scale"), 1080.0, 0.3))
    assert [r[0] for r in w.collect()] == [500.0, 972.0, 324.0]
    s = make([("a", ["[fine] may not fit: x"], "energy"), ("b", None, "words")], "short string, notes array<string>, asr string")
    p = make([("a", ["bad_angle"]), ("a", []), ("b", [])], "short string, flags array<string>")
    m = make([("a", "CHECK showing?")], "short string, name string")
    assert {r.short: r.flags for r in sinks.review_flags(s, p, m, K, "may not fit").collect()} == {"a": ["1 bad angle", "1 silent stretch(es) to review", "may not fit", "no word timings"], "b": []}


def test_ingest(make):
    info = make([(n, f"/{n}", 25.0, 9.0) for n in "abcd"], "short string, path string, fps double, duration double")
    levels = make([("/a", 0, 0, -10.0), ("/a", 0, 1, -12.0), ("/b", 0, 0, -10.0), ("/b", 0, 1, -10.0), ("/b", 1, 0, -90.0), ("/c", 0, 0, -80.0)], "path string, stream int, channel int, peak double")
    alike = make([("/a", 0.2, 1.0), ("/b", 1.0, 1.0)], "path string, corr double, ratio double")
    got = {r.short: (r.mic, r.a1, r.a2, r.empty, r.enabled, len(r.notes)) for r in stages.ingest(info, levels, alike).collect()}
    assert got == {"a": ("two", [0, 0], [0, 1], [], True, 0), "b": ("single", [0, 0], None, [[1, 0]], True, 0), "c": ("single", None, None, [[0, 0]], False, 1), "d": ("none", None, None, [], False, 1)}
    folders = make([("29:09:26 Lian", "/x/1"), ("30:09:26 Ada", "/x/2"), ("01:10:26 test", "/x/3")], "name string, path string")
    assert [r.path for r in stages.newest_batch(folders, skip=["test"]).collect()] == ["/x/2"]


def test_command_line(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    main(["list"])
    assert "fine_plan" in capsys.readouterr().out.split()
    main(["run", "interval_merge", "/root/testdata/sf0.001", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["user_id", "s", "e"]
