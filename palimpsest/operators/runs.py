"""Batch runs against each other and over time."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_trend(runs: DataFrame, last: int) -> DataFrame:
    """Pass rate of the latest runs, skipped files in the total."""
    d = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("status") == "PASS", 1).otherwise(0)).alias("n_pass"), F.sum(F.when(F.col("status") == "FAIL", 1).otherwise(0)).alias("n_fail"))
    return d.withColumn("pass_share", F.col("n_pass") / F.greatest("n", F.lit(1))).orderBy(F.desc("run")).limit(last)


def _latest(runs: DataFrame, run: int) -> DataFrame:
    return runs.where(F.col("run") == run).groupBy("file_id").agg(F.max(F.struct("o_orderkey", "status")).alias("s")).select("file_id", "s.status")


def changed_files(runs: DataFrame, old: int, new: int) -> DataFrame:
    a, b = _latest(runs, old), _latest(runs, new)
    return a.withColumnRenamed("status", "old_status").join(b.withColumnRenamed("status", "new_status"), "file_id").where("old_status <> new_status")


def status_counts(runs: DataFrame, old: int, new: int) -> DataFrame:
    """Counts by status in both runs; a status that one lacks counts 0."""
    a, b = (_latest(runs, r).groupBy("status").agg(F.count(F.lit(1)).alias(n)) for r, n in ((old, "n_old"), (new, "n_new")))
    return a.join(b, "status", "full").select("status", F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
