"""Stored tables that change: merges that rewrite only the buckets they touch, runs recorded as a whole, posts by day."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.forum import when_posted
from .batches import record_batch

BUCKETS = 64


def there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _gone(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge(path: str, found: DataFrame, key: str, fields: list[str], rule: Callable[[DataFrame, DataFrame, str, list[str]], DataFrame], buckets: int = BUCKETS) -> int:
    """Merges found rows (one for each key) into the table at path by `rule` (ledger.upserted, ledger.replaced_fields): copy on write, one folder a bucket of keys. Returns how many buckets were rewritten.

    The buckets that found rows fall into (at most `buckets`, whatever the table's size) are read, merged and written beside the table; only when that is done do they replace the old ones. A merge that fails
    before leaves the table as it was. A null key has no row to meet and is left out. One writer at a time.
    """
    spark = found.sparkSession
    new = found.where(F.col(key).isNotNull()).select(key, *fields).withColumn("bucket", bucket_of(key, buckets))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    if not touched:
        return 0
    old = new.limit(0)
    if there(spark, path):
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(key, *fields, "bucket")
    merged = rule(old.drop("bucket"), new.drop("bucket"), key, fields).withColumn("bucket", bucket_of(key, buckets))
    beside = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    try:
        merged.repartition("bucket").write.partitionBy("bucket").parquet(beside)
        spark.read.schema(merged.schema).parquet(beside).repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    finally:
        _gone(spark, beside)
    return len(touched)


def run_tables(diagnosed: DataFrame) -> dict[str, DataFrame]:
    """What a run leaves in the store: a row of the run, its books, the conversions of books that could be extracted and the issues of those.

    diagnosed: rows of diagnostics.diagnose() with run. A book that could not be extracted has no conversion, and so no issues.
    """
    n = lambda s: F.count_if(F.col("status") == s).alias(f"books_{s.lower()}")
    scored = F.coalesce("vqa_attempted", F.lit(False)) & F.col("vqa_score").isNotNull()
    run = diagnosed.groupBy("run").agg(F.count(F.lit(1)).alias("books_total"), *(n(s) for s in ("PASS", "WARN", "FAIL", "ERROR")), F.round(F.sum(F.coalesce("cost_cents", F.lit(0))) / 100, 4).alias("total_api_cost"), F.avg(F.when(scored, F.col("vqa_score"))).alias("avg_vqa_score"))
    whole = diagnosed.where("extraction_success")
    rest = [c for c in diagnosed.columns if c not in ("run", "book_id", "filename", "status", "reason")]
    books = diagnosed.select("run", "book_id", "filename", "status", F.col("reason").alias("status_reason"), F.to_json(F.struct(*rest)).alias("diagnostics"))
    conversions = whole.select("run", "book_id", "extraction_path", F.when(scored, F.col("vqa_score")).alias("vqa_score"), F.col("text_layer_score").alias("text_quality_score"), "cost_cents")
    issues = whole.select("run", "book_id", F.explode("issues").alias("i")).select("run", "book_id", F.col("i.pattern").alias("category"), "i.severity")
    return {"batch_runs": run, "batch_books": books, "conversions": conversions, "issues": issues}


def record_run(diagnosed: DataFrame, root: str) -> None:
    """Writes run_tables() under root, each by run; runs that are there already are replaced, others stay. The runs' own rows come last, so a run that has one is whole."""
    tables = run_tables(diagnosed)
    for name in ("batch_books", "conversions", "issues", "batch_runs"):
        record_batch(tables[name], f"{root}/{name}")


def write_posts(posts: DataFrame, path: str) -> None:
    """Posts in one folder a day; those whose time cannot be read in a folder of their own, which is the null day."""
    at = when_posted(F.col("datetime")).cast("timestamp_ntz")
    dated = posts.withColumn("at", at).withColumn("day", F.col("at").cast("date"))
    dated.repartition("day", F.pmod(F.hash(*posts.columns), F.lit(8))).write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def posts_between(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Posts of a stored table between two times, both included; a bound may be left out. Posts without a readable time stay. Only the days' own folders and that one are read."""
    d, keep, days = spark.read.parquet(path), F.lit(True), F.lit(True)
    for bound, of in ((since, Column.__ge__), (until, Column.__le__)):
        if bound is not None:
            t = F.lit(bound).cast("timestamp_ntz")
            keep, days = keep & of(F.col("at"), t), days & of(F.col("day"), F.lit(bound).cast("date"))
    return d.where((F.col("day").isNull() | days) & (F.col("at").isNull() | keep))
