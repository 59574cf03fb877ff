"""Sketches of runs that are stored and merged: distinct counts by HyperLogLog, quantiles by KLL.

A run is read once; what is asked later of any runs together, or of levels above them, is answered from the sketches alone. Both merge without growing: a distinct sketch has 2 ** PRECISION
registers, a quantile sketch some thousands of bytes however many values it has seen.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 12
#: Bounds held in tests: three standard errors of a distinct count, and the rank of a quantile.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (PRECISION / 2), 0.03


def sketched(rows: DataFrame, keys: list[str], distinct: str, value: str) -> DataFrame:
    """A row of sketches for each value of the keys: ids, of the column `distinct`; values, of `value`; and n, the number of rows. Nulls are in neither."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(distinct, F.lit(PRECISION)).alias("ids"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values"), F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, levels: list[str]) -> DataFrame:
    """Sketches of all levels of a rollup: by all keys, by fewer, over everything (keys that are merged are null, grouping tells which)."""
    return sketches.rollup(*levels).agg(F.grouping_id().alias("grouping"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("values").alias("values"), F.sum("n").alias("n"))


def distinct_count(ids: Column) -> Column:
    return F.hll_sketch_estimate(ids)


def quantile(values: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(values, F.lit(q))


def exact(rows: DataFrame, levels: list[str], distinct: str, value: str, q: float = 0.5) -> DataFrame:
    """What merged() estimates, counted from the rows: grouping, n_distinct, quantile (an actual value), n."""
    d = rows.rollup(*levels).agg(F.grouping_id().alias("grouping"), F.countDistinct(distinct).alias("n_distinct"), F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias("quantile"), F.count(F.lit(1)).alias("n"))
    return d


def near(estimate: Column, true: Column) -> Column:
    """Whether a distinct count is as near as promised."""
    return F.abs(estimate - true) <= F.greatest(F.lit(1.0), true * DISTINCT_ERROR)


def with_rank(told: DataFrame, rows: DataFrame, levels: list[str], value: str, estimate: Column) -> DataFrame:
    """told (grouping, levels and more) with below and up_to: the shares of the rows under each estimate, and not above it, counted from the rows."""
    groups = [F.struct(F.lit((1 << len(levels) - k) - 1).cast("long").alias("grouping"), *((F.col(x) if i < k else F.lit(None).cast("string")).alias(x) for i, x in enumerate(levels))) for k in range(len(levels) + 1)]
    d = told.withColumn("_told", estimate).withColumn("grouping", F.col("grouping").cast("long"))
    each = rows.select(F.explode(F.array(*groups)).alias("g"), F.col(value).alias("_value")).select("g.grouping", *(F.col(f"g.{x}").alias(f"_{x}_") for x in levels), "_value")
    small = d.select("grouping", *levels, "_told")
    on = [small["grouping"] == each["grouping"], *(small[x].eqNullSafe(each[f"_{x}_"]) for x in levels)]
    counts = each.join(small, on).groupBy(small["grouping"], *(small[x] for x in levels)).agg(F.avg((F.col("_value") < F.col("_told")).cast("int")).alias("below"), F.avg((F.col("_value") <= F.col("_told")).cast("int")).alias("up_to"))
    counts = counts.select(F.col("grouping").alias("_g"), *(F.col(x).alias(f"_c_{x}") for x in levels), "below", "up_to")
    return d.join(counts, [F.col("grouping") == F.col("_g"), *(F.col(x).eqNullSafe(F.col(f"_c_{x}")) for x in levels)])


def rank_near(q: float) -> Column:
    """Whether an estimate's rank, as with_rank() counts it, is as near as promised."""
    return (F.col("below") <= q + RANK_ERROR) & (F.col("up_to") >= q - RANK_ERROR)
