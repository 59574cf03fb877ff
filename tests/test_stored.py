"""Stored tables: merges, runs, posts by day; claims across restarts; streams that wait for each other."""
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import diagnostics as D
from palimpsest.operators.ledger import replaced_fields, upserted
from palimpsest.sources import stored
from palimpsest.sources.tables import view
from palimpsest.streaming import claims

SF = "/root/testdata/sf0.001"


def parts(path):
    return {p.name: sorted(f.name for f in p.iterdir() if f.name.endswith(".parquet")) for p in path.iterdir() if p.name.startswith("bucket=")}


def test_merges_rewrite_only_their_buckets(spark, tmp_path):
    path, fields = str(tmp_path / "books"), ["producer", "pages"]
    schema = "id long, producer string, pages long"
    first = spark.createDataFrame([(k, None if k % 3 else f"p{k}", k if k % 2 else 0) for k in range(400)], schema)
    assert stored.merge(path, first, "id", fields, upserted, 16) == 16
    before = parts(tmp_path / "books")
    second = spark.createDataFrame([(7, "new", 9), (9, "other", 1), (1000, "x", 5), (None, "y", 1)], schema)
    n = stored.merge(path, second, "id", fields, upserted, 16)
    after = parts(tmp_path / "books")
    assert n <= 3 and sum(before[k] != after[k] for k in before) == n
    rows = {r["id"]: (r["producer"], r["pages"]) for r in spark.read.parquet(path).collect()}
    assert len(rows) == 401 and rows[7] == ("new", 7) and rows[9] == ("p9", 9) and rows[1000] == ("x", 5)
    bad = second.withColumn("pages", F.when(F.col("id") == 9, F.raise_error(F.lit("broken"))).otherwise(F.col("pages")))
    with pytest.raises(Exception, match="broken"):
        stored.merge(path, bad, "id", fields, upserted, 16)
    assert parts(tmp_path / "books") == after and [p.name for p in tmp_path.iterdir()] == ["books"]
    stored.merge(path, spark.createDataFrame([(7, None, 70)], schema), "id", fields, replaced_fields, 16)
    assert spark.read.parquet(path).where("id = 7").select("producer", "pages").first() == ("new", 70)
    assert stored.merge(path, second.limit(0), "id", fields, upserted, 16) == 0


def test_recorded_runs(spark, tmp_path):
    d = D.diagnose(view(spark, SF, "diags_v"))
    stored.record_run(d, str(tmp_path / "store"))
    stored.record_run(d.where("run = 1 AND book_id < 50"), str(tmp_path / "store"))  # again, with fewer books
    read = lambda t: spark.read.parquet(str(tmp_path / "store" / t))
    runs = {r["run"]: r for r in read("batch_runs").collect()}
    assert set(runs) == {0, 1} and runs[1]["books_total"] == 25 and runs[0]["books_total"] == d.where("run = 0").count()
    assert read("batch_books").where("run = 1").count() == 25
    whole = d.where("extraction_success AND (run = 0 OR book_id < 50)")
    assert read("conversions").count() == whole.count()
    assert read("issues").count() == whole.agg(F.sum(F.size("issues"))).first()[0]
    assert read("batch_books").where("diagnostics IS NULL").count() == 0


def test_posts_are_read_by_day(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = [(k, f"2024-01-{1 + k % 28:02d}T{k % 24:02d}:30:00+0200" if k % 10 else "yesterday", f"body {k}") for k in range(560)]
    posts = spark.createDataFrame(rows, "id long, datetime string, body string")
    stored.write_posts(posts, path)
    files = lambda d: len(d.inputFiles())
    some = stored.posts_between(spark, path, "2024-01-05 12:00:00", "2024-01-07 06:00:00")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = lambda d: next(int(m.value()) for m in [d._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles").get()])
    got = {r["id"] for r in some.collect()}
    kept = {k for k, t, _ in rows if not k % 10 or "2024-01-05T12:00:00" <= t[:19] <= "2024-01-07T06:00:00"}
    assert got == kept
    every = stored.posts_between(spark, path)
    assert every.count() == 560
    counts = []
    for until in ("2024-01-05 23:59:59", "2024-01-10 23:59:59", "2024-01-28 23:59:59"):
        d = stored.posts_between(spark, path, "2024-01-05 00:00:00", until)
        d.collect()
        plan = d._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan
        counts.append(plan.collectLeaves().head().metrics().get("numFiles").get().value())
    assert counts[0] < counts[1] < counts[2] < files(every) and read is not None


def test_claims_are_sent_once_over_a_crash(spark, tmp_path):
    rng, schema = random.Random(2), "job_id long, recipient string, ts timestamp, seq long"
    rows = [(rng.randrange(12), f"r{rng.randrange(4)}@x.org", k, k) for k in range(160)]
    for k in range(4):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], "job_id long, recipient string, at long, seq long").selectExpr("job_id", "recipient", "timestamp_seconds(at) AS ts", "seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sink, calls = claims.to_folder(str(tmp_path / "sent")), []

    def crashing(got, batch_id):
        sink(got, batch_id)
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("killed after the send, before the batch was marked done")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = claims.send_once(stream, str(tmp_path / "claims"), str(tmp_path / "check"), crashing)
        q.awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        run()
    run()
    assert calls.count(1) == 2 and calls.count(2) == 1
    sent = [(r["job_id"], r["recipient"]) for r in spark.read.parquet(str(tmp_path / "sent")).collect()]
    assert len(sent) == len(set(sent)) == len({(j, r) for j, r, _, _ in rows})
    assert all(len(r) == 64 for _, r in sent)


def test_events_wait_for_jobs_that_come_late(spark, tmp_path):
    jobs = [(f"m{k}", k, 1000 + 10 * k) for k in range(30)]
    events = [(f"m{k % 40}", 1005 + 10 * (k % 40) + k, k) for k in range(90)]
    names = {"jobs": "message_id string, job_id long, job_ts timestamp", "events": "message_id string, event_ts timestamp, n long"}

    def put(name, rows):
        cols = ("message_id", "job_id", "timestamp_seconds(at) AS job_ts") if name == "jobs" else ("message_id", "timestamp_seconds(at) AS event_ts", "n")
        spark.createDataFrame(rows, "message_id string, job_id long, at long" if name == "jobs" else "message_id string, at long, n long").selectExpr(*cols).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        read = lambda n: spark.readStream.schema(names[n]).parquet(str(tmp_path / n))
        q = claims.matched_streams(read("events"), read("jobs"), "10 minutes", "1 minutes", "5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    put("events", events[:60])
    put("jobs", jobs[:3])
    run()  # most events are there before their jobs
    put("jobs", jobs[3:])
    put("events", events[60:])
    run()
    table = lambda n: spark.read.parquet(str(tmp_path / n))
    want = claims.matched_streams(table("events"), table("jobs"), "10 minutes", "1 minutes", "5 minutes")
    got = sorted((r["n"], r["job_id"]) for r in table("out").collect())
    assert got == sorted((r["n"], r["job_id"]) for r in want.collect()) and len(got) > 50
