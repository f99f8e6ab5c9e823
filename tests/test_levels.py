"""Levels of rolling windows to the last bit, as SQL's quantile_cont gives them; values often lie right at a level."""

import random

import duckdb

from tidemark import queries
from tidemark.operators import signals

RUN = [7.63, 74.31, 3.9, 9.46, 51.11, 153.11, 10.05, 60.0, 101.61, 1.31, 37.75, 4.54, 42.05, 20.96, 22.76, 13.86, 104.1, 23.91, 82.94, 12.56, 1.04, 40.89, 15.97, 0.37]
RUN += [58.49, 3.77, 43.12, 110.91, 32.93, 42.29, 235.72, 14.42, 45.43, 19.03, 40.59, 67.77, 71.95, 2.6, 96.8, 62.59, 173.13, 2.11, 51.63, 54.1, 118.77, 9.24, 9.71]
START = [83.64, 76.93, 74.05, 18.85, 5.18, 56.58, 15.99, 18.06, 33.79, 35.64, 40.71, 44.2, 17.54, 32.14, 93.08, 74.45, 58.73, 80.65, 31.85, 7.22, 87.74, 226.81, 44.14, 0.6]
START += [34.43, 6.92, 11.37, 14.05, 8.38, 9.69, 35.79, 5.04, 2.67, 8.27, 6.79, 34.61, 93.82, 67.85, 37.65, 19.11]

# The first frames of user 30129, the one with another edge (mark 18) among 6,000,000 events dealt over 90,000 users
DEALT = [119.45, 53.23, 53.95, 48.72, 56.29, 10.25, 9.83, 26.95, 26.12, 0.93, 8.38, 13.09, 36.32, 40.82, 162.7, 10.82, 46.39, 40.83, 22.89, 13.42, 195.41, 1.54]
DEALT += [74.51, 63.81, 41.8, 65.54, 51.96, 36.21, 224.08, 31.32, 16.8, 144.11, 0.58, 101.66, 4.13, 1.93, 24.61, 48.97]


def levels(spark, values, frac):
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "u long, i long, v double")
    return signals.threshold(f, ["u"], "v", "th", frac=frac, floor=None, half=20).select("u", "i", "v", "th")


def test_levels_are_those_of_sql(spark):
    dice = random.Random(7)
    values = [round(dice.random() * dice.choice([0.2, 3, 300]), 2) for _ in range(400)]
    sql = """SELECT i, lo + 0.35::DOUBLE * (hi - lo) FROM (SELECT i, quantile_cont(v, 0.15) OVER w AS lo, quantile_cont(v, 0.85) OVER w AS hi
      FROM (SELECT unnest(range(400)) AS i, unnest(?) AS v) WINDOW w AS (ORDER BY i ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING))"""
    assert {r.i: r.th for r in levels(spark, values, 0.35).collect()} == dict(duckdb.execute(sql, [values]).fetchall())


def test_loud_run_at_a_level(spark):
    r = spark.createDataFrame([(1, 31, 51)], "u long, x long, y long")
    assert signals.loud_run(r, levels(spark, RUN, 0.5), ["u"], need=7).first().loud is False


def test_scan_start_at_a_level(spark):
    marks = spark.createDataFrame([(1, 8, 12, 0)], "u long, mark long, start long, limit long")
    assert signals.scan(marks, levels(spark, START, 0.35), ["u"], False, quiet=3).first().edge == 9


def test_scan_start_agrees_with_sql_at_a_level(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE frames AS SELECT unnest(range(38)) AS i, unnest(?) AS v", [DEALT])
    duck.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, v AS value FROM frames")
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    got = {r.mark: r.edge for r in queries.scan_start(spark, str(tmp_path)).collect()}
    assert got[18] == 12
    assert got == {mark: edge for _, mark, edge in duck.execute(queries.ORACLE_SQL["scan_start"]).fetchall()}


def test_scans_agree_with_sql_on_frames_without_values(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE events AS SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 10 <> 3 THEN value END AS value FROM '/root/testdata/sf0.001/events.parquet'")
    duck.execute("INSERT INTO events SELECT -1 - i, TIMESTAMP '2024-01-01', -1, 'view', NULL FROM range(30) t(i)")  # none at all
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    for name in ("scan_start", "scan_end"):
        got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(duck.execute(queries.ORACLE_SQL[name]).fetchall())


def test_sound_without_levels_and_with_one_frame(spark):
    f = spark.createDataFrame([(1, 0, -3.0)], "u long, i long, db double")
    got = {r.i: (r.v, r.th, r.th_run, r.n) for r in signals.sound(f, ["u"], half=2).collect()}
    assert got == {0: (-1.0, -3.0, -3.0, 1), 1: (None, -3.0, -3.0, 1), 2: (None, -3.0, -3.0, 1)}
