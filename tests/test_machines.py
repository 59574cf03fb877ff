"""State machines over streams against their batch twins, with late and repeated events and restarts."""
import random

from pyspark.sql import functions as F

from palimpsest.streaming import machines as M
from palimpsest.streaming.events import delivery_state


def fed(spark, path, rows, schema, parts):
    """Rows in files that one micro-batch reads each, the last of them far in the future so that the watermark passes all."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if isinstance(rows, list) else rows(k), schema).coalesce(1).write.mode("append").parquet(str(path))


def drained(spark, make, tmp_path, schema, name):
    """What the stream has given when all files are read; begun again from its checkpoint each time it is called."""
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return [r.asDict() for r in spark.read.parquet(str(tmp_path / name)).collect()]


def put(spark, tmp_path, rows, schema):
    ts = F.timestamp_seconds("at")
    spark.createDataFrame(rows, schema).withColumn("ts", ts).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


FAR = 10_000_000


def test_deliveries_end_as_the_batch_twin(spark, tmp_path):
    rng = random.Random(3)
    kinds = [*M.DELIVERED, M.DELAYED, M.DELAYED, "sent"]
    rows = [(f"m{rng.randrange(25)}", 1000 + rng.randrange(400), k, rng.choice(kinds)) for k in range(240)]
    rows += rows[::9]  # repeated
    rng.shuffle(rows)
    schema = "key string, at long, seq long, status string"
    for k in range(4):
        put(spark, tmp_path, rows[k::4], schema)
        if k == 1:
            drained(spark, lambda s: M.deliveries(s, "1 hour", 3600), tmp_path, f"{schema}, ts timestamp", "out")
    put(spark, tmp_path, [("end", FAR, 0, "sent")], schema)
    put(spark, tmp_path, [("end", FAR + 1, 0, "sent")], schema)
    got = drained(spark, lambda s: M.deliveries(s, "1 hour", 3600), tmp_path, f"{schema}, ts timestamp", "out")
    events = spark.createDataFrame(rows, schema).selectExpr("key", "at AS ts", "seq AS event_id", "status AS event_type")
    want = {r["key"]: r["state"] for r in delivery_state(events, "key", M.DELIVERED, M.DELAYED).collect()}
    last = {}
    for r in sorted((r for r in got if not r["settled"] and r["key"] != "end"), key=lambda r: r["version"]):
        last[r["key"]] = r["status"]
    assert last == want
    settled = [(r["key"], r["status"]) for r in got if r["settled"]]
    assert len(settled) == len(set(settled)) and dict(settled) == want


def calls(seed, keys, n):
    rng, rows = random.Random(seed), []
    for k in range(keys):
        at = 1000
        for _ in range(n):
            at += rng.choice([0, 1, 2, 5, 12, 29, 30, 31, 59, 60, 61, 90])
            rows.append((f"k{k}", at, len(rows), rng.random() < 0.85))
    return rows


def plain_periods(rows):
    """Second by second: open while a failure, the fifth or later of its run, is less than 30 s old."""
    out = []
    for key in sorted({r[0] for r in rows}):
        mine, n, last, until, half_until, marks = sorted(r[1:] for r in rows if r[0] == key), 0, None, -1, -1, {}
        end = mine[-1][0] + 100
        k = 0
        for at in range(mine[0][0], end):
            while k < len(mine) and mine[k][0] == at:
                half_until = -1
                if mine[k][2]:
                    n = 1 if last is not None and at - last > 60 else n + 1
                    last = at
                    if n >= 5:
                        until, half_until = at + 30, at + 60
                else:
                    n, last, half_until = 0, None, -1
                k += 1
            marks[at] = "open" if at < until else "half_open" if at < half_until else ""
        runs = []
        for at in sorted(marks):
            if marks[at] and runs and runs[-1][0] == marks[at] and runs[-1][2] == at:
                runs[-1][2] = at + 1
            elif marks[at]:
                runs.append([marks[at], at, at + 1])
        out += [(key, *r) for r in runs]
    return out


def joined(rows):
    """Periods that touch as one."""
    out = []
    for key, state, a, b in sorted(rows, key=lambda r: (r[0], r[2])):
        if out and out[-1][0] == key and out[-1][1] == state and out[-1][3] == a:
            out[-1] = (key, state, out[-1][2], b)
        else:
            out.append((key, state, a, b))
    return sorted(out)


def test_breaker_periods_second_by_second(spark):
    rows = calls(1, 30, 60)
    got = [tuple(r) for r in M.breaker_periods(spark.createDataFrame(rows, "key string, at long, seq long, failed boolean"), "key", "at", "seq", "failed").collect()]
    assert len({r[1] for r in got}) == 2 and joined(got) == sorted(plain_periods(rows))


def test_breakers_as_a_stream(spark, tmp_path):
    rows = calls(2, 8, 40)
    rng, schema = random.Random(1), "key string, at long, seq long, failed boolean"
    mixed = rows + rows[::7]
    rng.shuffle(mixed)
    for k in range(3):
        put(spark, tmp_path, mixed[k::3], schema)
        if k == 0:
            drained(spark, lambda s: M.breakers(s, "2 hours"), tmp_path, f"{schema}, ts timestamp", "out")
    for k in range(2):
        put(spark, tmp_path, [("end", FAR + k, k, False)], schema)
    got = drained(spark, lambda s: M.breakers(s, "2 hours"), tmp_path, f"{schema}, ts timestamp", "out")
    want = [tuple(r) for r in M.breaker_periods(spark.createDataFrame(rows, schema), "key", "at", "seq", "failed").collect()]
    assert sorted((r["key"], r["state"], r["began"], r["ended"]) for r in got) == sorted(want)


def test_sweeps_emit_each_expiry_once(spark, tmp_path):
    rng, schema = random.Random(4), "key string, at long, expires_at long, used boolean"
    rows = [(f"t{k}", 1000 + k, 2000 + rng.randrange(50_000), False) for k in range(60)]
    rows += [(f"t{k}", 1500 + k, None, True) for k in range(0, 60, 2)]
    rows += rows[::5]
    put(spark, tmp_path, rows[:70], schema)
    for make, name in ((lambda s: M.sweeps(s, "1 hour", 600), "jobs"), (lambda s: M.sweeps(s, "1 hour", 3600, 5000, True), "tokens")):
        drained(spark, make, tmp_path, f"{schema}, ts timestamp", name)  # stops, and goes on from its checkpoint below
    put(spark, tmp_path, rows[70:], schema)
    put(spark, tmp_path, [("clock", 30_000, None, False)], schema)
    put(spark, tmp_path, [("clock", 30_001, None, False)], schema)
    put(spark, tmp_path, [("clock", FAR, None, False)], schema)
    put(spark, tmp_path, [("clock", FAR + 1, None, False)], schema)
    table = spark.createDataFrame(rows, schema)
    for make, name, args in ((lambda s: M.sweeps(s, "1 hour", 600), "jobs", (600,)), (lambda s: M.sweeps(s, "1 hour", 3600, 5000, True), "tokens", (3600, 5000, True))):
        got = [(r["key"], r["swept_at"]) for r in drained(spark, make, tmp_path, f"{schema}, ts timestamp", name)]
        want = [tuple(r) for r in M.swept(table, FAR - 3600, *args).collect()]
        assert len(got) == len(set(got)) and sorted(got) == sorted(want) and want
        assert name == "jobs" or len(want) == 30
