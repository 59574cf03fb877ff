"""Claims that are granted once across micro-batches, and joins of streams that wait for each other."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import there
from .events import first_claims

KEYS = ["job_id", "recipient"]


def granted(batch: DataFrame, batch_id: int, path: str) -> DataFrame:
    """The claims of a micro-batch that no earlier one holds, the first of each job and recipient, stored as that batch's part of the claims.

    A batch that is run again meets the same earlier claims and rewrites its own part, so it grants what it granted before and nothing else. Recipients are kept as digests alone.
    """
    spark = batch.sparkSession
    own = first_claims(batch.select("job_id", F.sha2(F.col("recipient"), 256).alias("recipient"), "ts", "seq"), KEYS, "ts", "seq")
    if there(spark, path):
        earlier = spark.read.schema("job_id long, recipient string, ts timestamp, seq long, batch long").parquet(path).where(F.col("batch") < batch_id)
        own = own.join(earlier.select(*KEYS), KEYS, "left_anti")
    own.withColumn("batch", F.lit(batch_id).cast("long")).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return spark.read.schema("job_id long, recipient string, ts timestamp, seq long, batch long").parquet(path).where(F.col("batch") == batch_id)


def send_once(claims: DataFrame, path: str, checkpoint: str, send: Callable[[DataFrame, int], None]):  # noqa: ANN201
    """Starts a stream of claims (job_id, recipient, ts, seq) that sends each job to each recipient once; send gets granted rows and the batch's number, by which it must know a batch that it has done."""
    run = lambda batch, batch_id: send(granted(batch, batch_id, path), batch_id)
    return claims.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a batch done again replaces."""

    def send(rows: DataFrame, batch_id: int) -> None:
        rows.select("job_id", "recipient", "ts", "seq").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return send


def matched_streams(events: DataFrame, jobs: DataFrame, late: str, before: str, after: str) -> DataFrame:
    """Events beside the job whose message they tell of, whichever arrives first. events: message_id, event_ts and more; jobs: message_id, job_id, job_ts.

    An event may lie `before` its job's time to `after` it; both sides wait in state until the watermarks tell that nothing more can match. Of tables the same join is the batch twin.
    """
    if events.isStreaming:
        events, jobs = events.withWatermark("event_ts", late), jobs.withWatermark("job_ts", late)
    e, j = events.alias("e"), jobs.alias("j")
    near = F.expr(f"e.event_ts >= j.job_ts - INTERVAL {before} AND e.event_ts <= j.job_ts + INTERVAL {after}")
    return e.join(j, (F.col("e.message_id") == F.col("j.message_id")) & near).select("e.*", "j.job_id", "j.job_ts")
