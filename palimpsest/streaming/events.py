"""Event logs: what happens over time, as batch plans and as streams."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_claims(events: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first event of each key; later ones are repeats. Summed before the shuffle, so a key with very many events is no hot one. Columns must be orderable."""
    rest = [c for c in events.columns if c not in keys and c not in order]
    d = events.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_e"))
    return d.select(*(c if c in keys else F.col("_e")[c].alias(c) for c in events.columns))


def rate_limited(events: DataFrame, key: str, most: int, unit: str = "minute") -> DataFrame:
    """Requests by key and fixed window, and how many are over the limit."""
    d = events.groupBy(key, F.date_trunc(unit, "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("n_refused", F.greatest(F.lit(0), F.col("n") - most)).where("n_refused > 0")


def whole_seconds(ts: str) -> Column:
    """A time as seconds since 1970, rounded to the nearest, halves to the even one."""
    return F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("long")


def breaker_openings(events: DataFrame, key: str, failed: str, threshold: int = 5, gap_seconds: int = 60) -> DataFrame:
    """Times at which each key's breaker opens: `threshold` failures in a row, no success and no longer gap (in rounded seconds) between them."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    late = whole_seconds("ts") - F.lag(whole_seconds("ts")).over(w) > gap_seconds
    start = F.when(~F.lag(F.col(failed)).over(w) | late | F.lag("ts").over(w).isNull(), 1).otherwise(0)
    d = events.withColumn("_start", start).withColumn("_run", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col(failed))
    return d.withColumn("_n", F.row_number().over(W.partitionBy(key, "_run").orderBy("ts", "event_id"))).where(F.col("_n") == threshold).select(key, F.col("ts").alias("opened_at"))


def expired(events: DataFrame, now: str, keep_days: int) -> DataFrame:
    """By type: what a sweep at `now` removes and keeps."""
    gone = F.col("ts") < F.expr(f"timestamp_ntz '{now}' - interval {keep_days} days")
    return events.groupBy("event_type").agg(F.sum(F.when(gone, 1).otherwise(0)).alias("n_gone"), F.sum(F.when(gone, 0).otherwise(1)).alias("n_kept"))


def counts_since(events: DataFrame, since: str) -> DataFrame:
    return events.where(F.col("ts") >= F.expr(f"timestamp_ntz '{since}'")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def window_counts(events: DataFrame, length: str) -> DataFrame:
    """Events by type and tumbling window; events may be a stream (with a watermark for late rows)."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark("ts", length)
    d = d.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def delivery_state(events: DataFrame, key: str, terminal: tuple[str, ...], delayed: str) -> DataFrame:
    """The state each message ends in: the last event wins, but a delay after a terminal state changes nothing.

    A terminal event is no delay and comes after every delay that counts, so with one the last event that is no delay wins, without one the last of all.
    """
    last = F.struct("ts", "event_id", "event_type")
    d = events.groupBy(key).agg(F.max(last).alias("all"), F.max(F.when(F.col("event_type") != delayed, last)).alias("sure"), F.max(F.col("event_type").isin(*terminal)).alias("ended"))
    return d.select(key, F.when(F.col("ended"), F.col("sure.event_type")).otherwise(F.col("all.event_type")).alias("state"))


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of each key: when they began and how many events they have; events may be a stream."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if d.isStreaming:
        d = d.withWatermark("ts", gap)
    d = d.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return d.select(key, F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


def over_limit(events: DataFrame, key: str, most: int, seconds: int) -> DataFrame:
    """Events that are more than the `most`-th of their key within the last `seconds`, in rounded seconds."""
    at = whole_seconds("ts")
    return events.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(key).orderBy(at).rangeBetween(1 - seconds, 0))).where(F.col("n") > most)


def new_files(files: DataFrame, within: str) -> DataFrame:
    """Files of an inbox, each content once; files may be a stream, whose copies within the time are dropped. files: hash, ts."""
    if not files.isStreaming:
        return first_claims(files, ["hash"], "ts", "path")
    return files.withWatermark("ts", within).dropDuplicatesWithinWatermark(["hash"])
