from gridloom.streaming import ledger


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:{m:02d}:00", i % 2, "ab"[i % 2], float(i)) for i, (h, m) in enumerate([(0, 5), (0, 50), (1, 10), (1, 20), (5, 0), (9, 0)])]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = ledger.activity(stream).writeStream.outputMode("complete").format("memory").queryName("activity").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r.start), r.event_type, r.n, r.total)
    assert sorted(map(key, spark.table("activity").collect())) == sorted(map(key, ledger.activity(events).collect()))
    assert {(r.user_id, r.n) for r in ledger.sessions(events).collect()} == {(0, 2), (0, 1), (1, 2), (1, 1)}


def test_ledger_stream(spark, tmp_path):
    (tmp_path / "ledger").mkdir()
    (tmp_path / "ledger" / "a.json").write_text('{"candidate": "x", "verdict": "REJECT", "trials_after": 1, "timestamp_utc": "2024-01-01T00:00:00Z"}\n')
    q = ledger.trials(spark, f"{tmp_path}/ledger").writeStream.format("memory").queryName("trials").start()
    q.processAllAvailable()
    q.stop()
    assert [r.candidate for r in spark.table("trials").collect()] == ["x"]
