from plansmith.streaming import counts


def test_running_leaks_and_rates(spark, tmp_path):
    d = str(tmp_path / "in")
    rows = [("a", "train", "2024-01-01 00:00:01", True), ("a", "test", "2024-01-01 00:00:02", False), ("b", "train", "2024-01-01 00:10:00", True)]
    kind = "record_sha256 string, official_split string, ts timestamp, ok boolean"
    spark.createDataFrame(rows, "record_sha256 string, official_split string, t string, ok boolean").selectExpr("record_sha256", "official_split", "CAST(t AS timestamp) AS ts", "ok").write.parquet(d)
    s = spark.readStream.schema(kind).parquet(d)
    for name, df, mode in (("leaks", counts.running_leaks(s), "complete"), ("rates", counts.windowed_rate(s, "ok", "ts"), "complete"), ("firsts", counts.first_copies(s, "record_sha256", "ts", "1 hour"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert {(r["record_sha256"], r["splits"]) for r in spark.table("leaks").collect()} == {("a", 2), ("b", 1)}
    assert sorted((r["rows"], r["rate"]) for r in spark.table("rates").collect()) == [(1, 1.0), (2, 0.5)]
    assert spark.table("firsts").count() == 2
