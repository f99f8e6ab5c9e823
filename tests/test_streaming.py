from tidemark.streaming import live


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_sessions_and_windows(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 02:00:00"), ("b", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "k string, t string").selectExpr("k", "cast(t AS timestamp) AS ts").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    got = {(r.k, str(r.s), str(r.e), r.n) for r in drain(live.sessions(stream(), ["k"], "10 minutes", "1 minute"), "sess").collect()}
    assert ("a", "2024-01-01 00:00:00", "2024-01-01 00:05:00", 2) in got and ("a", "2024-01-01 02:00:00", "2024-01-01 02:00:00", 1) in got
    assert sum(r.n for r in drain(live.window_counts(stream(), ["k"], "1 hour", "1 minute"), "wins", "complete").collect()) == 4


def test_picks_go_on_across_batches(spark, tmp_path):
    src = f"{tmp_path}/in"
    for lo in (0, 3):
        spark.createDataFrame([("a", i) for i in range(lo, lo + 3)], "key string, pos int").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, pos int").option("maxFilesPerTrigger", 1).parquet(src)
    got = drain(live.pick_no_repeat(stream, ["x", "y", "z", "w"], 2), "picks").orderBy("pos").collect()
    assert [r.path for r in got] == ["x", "y", "z", "x", "y", "z"]
