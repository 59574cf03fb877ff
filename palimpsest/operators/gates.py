"""Page scores of two reports against each other, and signs of made-up scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Deduction by severity, 5 for others.
WEIGHTS = {"critical": 25, "major": 15, "moderate": 10, "minor": 5}
CORPUS_LIMIT, BOOK_LIMIT, LEAST_OVERLAP = 15.0, 20.0, 0.5
HIGH_SCORE, SURE_SHARE, LIKELY_SHARE = 80, 0.70, 0.55


def first_pages(report: DataFrame, *order: str) -> DataFrame:
    """One row for each page of a book: the first in order."""
    return report.withColumn("_place", F.row_number().over(W.partitionBy("book_id", "page_number").orderBy(*order))).where("_place = 1").drop("_place")


def book_deltas(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """By book of both reports: pages, overlap, mean and largest score difference, pages whose issues the candidate misses."""
    a = candidate.select("book_id", "page_number", F.col("score").alias("a"), F.col("n_issues").alias("a_issues"), F.lit(1).alias("in_a"))
    b = baseline.select("book_id", "page_number", F.col("score").alias("b"), F.col("n_issues").alias("b_issues"), F.lit(1).alias("in_b"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    in_a, in_b, delta = F.col("in_a").isNotNull(), F.col("in_b").isNotNull(), F.abs(F.col("a") - F.col("b"))
    d = a.join(b, ["book_id", "page_number"], "full").groupBy("book_id").agg(count(in_a).alias("candidate_pages"), count(in_b).alias("baseline_pages"), count(in_a & in_b).alias("overlap_pages"), F.avg(delta).alias("mean_delta"), F.max(delta).alias("max_delta"), count((F.col("a_issues") == 0) & (F.col("b_issues") > 0)).alias("misses"))
    return d.where("candidate_pages > 0 AND baseline_pages > 0").withColumn("overlap", F.col("overlap_pages") / F.greatest("candidate_pages", "baseline_pages"))


def gate(deltas: DataFrame) -> DataFrame:
    """One row: equal and page-weighted means over books with a mean, and whether the gate is passed."""
    pages = F.when(F.col("mean_delta").isNotNull(), F.col("overlap_pages"))
    d = deltas.agg(F.count(F.lit(1)).alias("n_books"), F.avg("mean_delta").alias("equal_mean"), (F.sum(F.col("mean_delta") * pages) / F.sum(pages)).alias("page_mean"), F.max("mean_delta").alias("worst_book"), F.coalesce(F.bool_or(F.col("overlap") < LEAST_OVERLAP), F.lit(False)).alias("overlap_fails"))
    return d.withColumn("passed", F.coalesce((F.col("equal_mean") < CORPUS_LIMIT) & (F.col("worst_book") <= BOOK_LIMIT), F.lit(False)))


def category_scores(issues: DataFrame) -> DataFrame:
    """100 less the mean deduction of the pages that have the category, 0 at least; rounded half to even."""
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("severity")], F.lit(5))
    d = issues.groupBy("book_id", F.coalesce("category", F.lit("unknown")).alias("category"), "page_number").agg(F.sum(weight).alias("deducted"))
    d = d.groupBy("book_id", "category").agg(F.sum("deducted").alias("deducted"), F.count(F.lit(1)).alias("n_pages"))
    return d.withColumn("score", F.greatest(F.lit(0), F.bround(100 - F.col("deducted") / F.col("n_pages"))).cast("long"))


def mode_of(a: Column, b: Column) -> Column:
    """Shares of kinds a and b to a verdict."""
    return F.when(a >= SURE_SHARE, "a").when(b >= SURE_SHARE, "b").when(a >= LIKELY_SHARE, "dominant-a").when(b >= LIKELY_SHARE, "dominant-b").otherwise("mixed")


def book_modes(pages: DataFrame) -> DataFrame:
    """pages: book_id, score, own_serious, other_serious. Kind a: a high score beside serious issues of its own; b: beside those that only the other report has."""
    high = F.col("score") >= HIGH_SCORE
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    d = pages.groupBy("book_id").agg(share(high & F.col("own_serious")).alias("share_a"), share(high & ~F.col("own_serious") & F.col("other_serious")).alias("share_b"), F.count(F.lit(1)).alias("n_pages"))
    return d.withColumn("mode", mode_of(F.col("share_a"), F.col("share_b")))


def overall_mode(books: DataFrame) -> DataFrame:
    """One row: the verdict over all books, by the shares of each family of modes; mixed without any."""
    share = lambda *modes: F.coalesce(F.avg(F.when(F.col("mode").isin(*modes), 1.0).otherwise(0.0)), F.lit(0.0))
    d = books.agg(share("a", "dominant-a").alias("share_a"), share("b", "dominant-b").alias("share_b"), F.count(F.lit(1)).alias("n_books"))
    return d.withColumn("mode", mode_of(F.col("share_a"), F.col("share_b")))


def roll_up(pages: DataFrame) -> DataFrame:
    """pages: book_id, page_number, score, issues (category, severity, description). By book the mean score, rounded half to even, and its moderate or graver issues, each description once, in the order of pages."""
    d = pages.groupBy("book_id").agg(F.bround(F.avg(F.coalesce("score", F.lit(0)))).cast("long").alias("score"), F.sort_array(F.collect_list(F.struct("page_number", "issues"))).alias("p"))
    grave = F.filter(F.flatten(F.transform("p", lambda x: F.coalesce(x["issues"], F.array()))), lambda i: i["severity"].isin("moderate", "major", "critical"))
    told = F.transform(grave, lambda i: i["description"])
    return d.select("book_id", "score", F.array_distinct(told).alias("top_issues"))


def uniform_scores(pages: DataFrame, least: int = 3, share: float = 0.75) -> DataFrame:
    """Pages at the score that `least` pages and `share` of their book's scored pages or more have; of equally common scores the one seen first counts."""
    d = pages.where("score IS NOT NULL").groupBy("book_id", "score").agg(F.count(F.lit(1)).alias("n"), F.min("page_number").alias("first"))
    top = d.groupBy("book_id").agg(F.sum("n").alias("n_scored"), F.max(F.struct("n", (-F.col("first")).alias("first"), "score")).alias("t"))
    top = top.where((F.col("t.n") >= least) & (F.col("t.n") >= share * F.col("n_scored"))).select("book_id", F.col("t.score").alias("score"))
    return pages.join(top, ["book_id", "score"], "left_semi")


def exit_codes(findings: DataFrame, key: str, codes: dict[str, int], kind: str) -> DataFrame:
    """The gravest code of each key's findings, 0 without one."""
    code = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[F.col(kind)]
    return findings.groupBy(key).agg(F.max(F.coalesce(code, F.lit(0))).alias("code"))
