"""Batches as tables: one partition for each run, replaced as a whole when a run is recorded again."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record_batch(diagnosed: DataFrame, path: str) -> None:
    """Writes the books of the runs that diagnosed holds; runs already stored are replaced, others stay."""
    diagnosed.write.partitionBy("run").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON reports of a folder, one document in each file; files that do not parse are left out."""
    return spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder).where("_bad IS NULL").drop("_bad")


def inventory(files: DataFrame, supported: tuple[str, ...] = ("pdf", "epub", "mobi", "azw", "azw3")) -> DataFrame:
    """files: path, size. By extension: how many, megabytes, whether it is supported, and the smallest, middle and largest file (of equals the first by name)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    d = files.withColumn("ext", ext).groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("size") / 1048576, 1).alias("megabytes"), F.min(F.struct("size", "path")).alias("s"), F.max(F.struct(F.col("size").alias("size"), "path")).alias("l"), F.percentile("size", 0.5).alias("middle"))
    return d.select("ext", "n", "megabytes", F.col("ext").isin(*supported).alias("supported"), F.col("s.path").alias("smallest"), "middle", F.col("l.path").alias("largest"))
