"""A stream gives what the batch plan gives."""
from palimpsest.sources.tables import table
from palimpsest.streaming.events import window_counts


def test_window_counts_stream_equals_batch(spark, tmp_path):
    events = table(spark, "/root/testdata/sf0.001", "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = window_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("windows").collect()))
    assert got and got == sorted(map(tuple, window_counts(events, "1 day").collect()))


def test_token_stream_equals_batch(spark, tmp_path):
    from palimpsest.operators.ledger import token_answers, token_stream

    rows = [(k % 5, 100 + k, k, ("mint", "consume", "dispute", "refund", "consume")[(k // 5 + k) % 5]) for k in range(60)]
    events = spark.createDataFrame(rows, "token long, ts long, seq long, action string")
    for k, (low, high) in enumerate(((0, 30), (30, 60))):  # two batches: the state outlives the first
        events.where(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = token_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, token_answers(events).collect())) and len(got) == 60


def test_sessions_stream_equals_batch_for_closed_sessions(spark, tmp_path):
    from palimpsest.streaming.events import sessions

    events = table(spark, "/root/testdata/sf0.001", "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "user_id", "30 minutes")
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = set(map(tuple, spark.table("sessions").collect())), set(map(tuple, sessions(events, "user_id", "30 minutes").collect()))
    assert got and got <= want and len(want) - len(got) < 0.2 * len(want)


def test_inbox_stream_drops_copies(spark, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.streaming.events import new_files

    files = spark.createDataFrame([(f"h{k % 7}", f"p{k}", k) for k in range(40)], "hash string, path string, k long").select("hash", "path", F.timestamp_seconds("k").alias("ts"))
    files.write.parquet(str(tmp_path / "in"))
    stream = new_files(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")), "1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName("inbox").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["hash"] for r in spark.table("inbox").collect()) == [f"h{k}" for k in range(7)]
    assert [r["path"] for r in new_files(files, "1 hour").orderBy("hash").collect()] == [f"p{k}" for k in range(7)]


def test_recorded_runs_replace_their_own(spark, tmp_path):
    from palimpsest.operators.reportfiles import RUN
    from palimpsest.sources.batches import read_reports, record_batch

    path = str(tmp_path / "runs")
    record_batch(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "run int, file string"), path)
    record_batch(spark.createDataFrame([(2, "d")], "run int, file string"), path)
    assert sorted((r["run"], r["file"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (1, "b"), (2, "d")]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.json").write_text('{"run_id": "r1",\n "summary": {"books_total": 2}}')
    (tmp_path / "json" / "b.json").write_text("{not json")
    assert [r["run_id"] for r in read_reports(spark, str(tmp_path / "json"), RUN).collect()] == ["r1"]
