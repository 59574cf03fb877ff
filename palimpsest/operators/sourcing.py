"""What kind of source a file is, and how to convert it; each stage reads what the one before set."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order matters: (condition, kind, confidence in hundredths).
KINDS = (("density < 50 AND image_dominant", "scan_no_text", 95), ("density < 50", "scan_no_text", 70), ("density < 500 AND (image_dominant OR kb_page > 100)", "scan_with_text", 85), ("density >= 500 AND NOT image_dominant", "digital_native", 90), ("TRUE", "digital_native", 60))


def classify_sources(files: DataFrame) -> DataFrame:
    """files: density (characters a page), image_dominant, kb_page, producer (lower case) and hit_rate (null: not known). Confidence in hundredths."""
    kind, sure = F.expr("CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in KINDS) + " END"), F.expr("CASE " + " ".join(f"WHEN {c} THEN {n}" for c, _, n in KINDS) + " END")
    archive, lura = F.contains("producer", F.lit("internet archive")), F.contains("producer", F.lit("lura"))
    d = files.withColumns({"kind": kind, "sure": sure})
    d = d.withColumn("garbled", F.coalesce((F.col("kind") == "digital_native") & (F.col("density") >= 500) & (F.col("hit_rate") < 0.05), F.lit(False)))
    d = d.withColumn("scanned", F.coalesce(archive | lura, F.lit(False)))
    low, by_archive = F.col("density") < 200, F.coalesce(archive, F.lit(False))
    by_lura = F.coalesce(lura, F.lit(False)) & low
    d = d.withColumns({"kind": F.when((by_archive | by_lura) & low, "scan_no_text").when(by_archive, "scan_with_text").otherwise(F.col("kind")), "sure": F.when(by_archive & low, F.greatest("sure", F.lit(85))).when(by_archive, F.greatest("sure", F.lit(70))).when(by_lura, F.greatest("sure", F.lit(80))).otherwise(F.col("sure")), "paid": (by_archive | by_lura) & low})
    heavy = (F.col("kind") == "digital_native") & (F.col("kb_page") > 25)
    d = d.withColumns({"kind": F.when(heavy, "scan_with_text").otherwise(F.col("kind")), "sure": F.when(heavy, F.least(F.lit(95), F.greatest(F.col("sure") - 10, F.lit(60)) + F.when(F.col("scanned"), 10).otherwise(0))).otherwise(F.col("sure"))})
    return d.withColumn("paid", F.col("paid") | ((F.col("density") < 50) & (F.col("kb_page") > 50)))


def merge_by_priority(stored: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored metadata after a find: each field is replaced where the stored one is null or of lower priority, and the found one is not null."""
    new = found.select(key, F.col("priority").alias("_priority"), *(F.col(f).alias(f"_{f}") for f in fields))
    higher = F.coalesce(F.col("_priority") > F.col("priority"), F.lit(True))
    pick = lambda f: F.when(F.col(f"_{f}").isNotNull() & (F.col(f).isNull() | higher), F.col(f"_{f}")).otherwise(F.col(f)).alias(f)
    return stored.join(new, key, "left").select(key, *(pick(f) for f in fields), F.greatest("priority", "_priority").alias("priority"))


def promoted_fixes(outcomes: DataFrame, least: int = 3, share: float = 0.7) -> DataFrame:
    """Success rate of each fix, recomputed from its outcomes in any order, and whether it is promoted."""
    d = outcomes.groupBy("fix").agg(F.count(F.lit(1)).alias("n_applied"), F.avg(F.when(F.col("worked"), 1.0).otherwise(0.0)).alias("success_rate"))
    return d.withColumn("promoted", (F.col("n_applied") >= least) & (F.col("success_rate") >= share))
