"""Reports, runs, answers and logs as text, and what is read from them. Text that cannot be read gives no rows or a default, never an error."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import strip_fences

REPORT = "book_id long, report string, pages array<struct<page_number: long, score: long, issues: array<struct<category: string, severity: string, description: string>>>>"
RUN = "run_id string, generated_at string, summary struct<books_total: long, books_passed: long, books_failed: long, books_warned: long, books_errored: long>, books array<struct<filename: string, overall_status: string>>"
ANSWER = "score long, issues array<struct<category: string, severity: string, description: string>>"


def as_reports(issues: DataFrame) -> DataFrame:
    """One JSON text for each book and report."""
    d = issues.groupBy("book_id", "report", "page_number").agg(F.max("score").alias("score"), F.collect_list(F.struct("category", "severity")).alias("issues"))
    d = d.groupBy("book_id", "report").agg(F.collect_list(F.struct("page_number", "score", "issues")).alias("pages"))
    return d.select(F.to_json(F.struct("book_id", "report", "pages")).alias("text"))


def report_issues(reports: DataFrame, text: str) -> DataFrame:
    """A row for each issue of each page; a category or severity that is not told is unknown."""
    d = reports.select(F.from_json(text, REPORT).alias("r")).select("r.book_id", "r.report", F.explode("r.pages").alias("p"))
    d = d.select("book_id", "report", "p.page_number", F.explode("p.issues").alias("i"))
    return d.select("book_id", "report", "page_number", F.coalesce("i.category", F.lit("unknown")).alias("category"), F.coalesce("i.severity", F.lit("unknown")).alias("severity"), "i.description")


def path_of(name: Column) -> Column:
    """How a report's book was extracted, by its file name."""
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("_legacy")), "legacy").when(F.contains(low, F.lit("_html")), "html_extraction").when(F.contains(low, F.lit("_column")), "column_aware").otherwise("unknown")


def as_runs(statuses: DataFrame) -> DataFrame:
    """One JSON text for each run. statuses: run, file_id, status."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("long")
    d = statuses.groupBy("run").agg(F.struct(F.count(F.lit(1)).alias("books_total"), n("PASS").alias("books_passed"), n("FAIL").alias("books_failed"), n("WARN").alias("books_warned"), n("ERROR").alias("books_errored")).alias("summary"), F.collect_list(F.struct(F.col("file_id").cast("string").alias("filename"), F.col("status").alias("overall_status"))).alias("books"))
    return d.select(F.to_json(F.struct(F.concat(F.lit("run"), F.col("run").cast("string")).alias("run_id"), "summary", "books")).alias("text"))


def run_history(runs: DataFrame, text: str) -> DataFrame:
    """Runs that can be read: counts, pass rate of all books, and status by file (a map)."""
    d = runs.select(F.from_json(text, RUN).alias("r")).where("r.run_id IS NOT NULL").select("r.*")
    total = F.coalesce("summary.books_total", F.lit(0))
    passed = F.coalesce("summary.books_passed", F.lit(0))
    return d.select("run_id", F.substring("generated_at", 1, 10).alias("date"), F.bround(passed * 100 / F.greatest(total, F.lit(1)), 1).alias("pass_rate"), total.alias("total"), passed.alias("passed"), F.map_from_entries(F.array_distinct("books")).alias("book_statuses"))


def parsed_answers(answers: DataFrame, text: str) -> DataFrame:
    """Answers read as JSON, fences and all; one that cannot be read has score 0, no issues, and failed."""
    d = answers.withColumn("_a", F.from_json(strip_fences(F.col(text)), ANSWER))
    failed = F.col("_a").isNull() | F.col("_a.score").isNull()
    return d.withColumns({"score": F.coalesce("_a.score", F.lit(0)), "issues": F.coalesce("_a.issues", F.array().cast("array<struct<category: string, severity: string, description: string>>")), "failed": failed}).drop("_a")


def log_facts(log: Column) -> dict[str, Column]:
    """Extraction path, number of chunks and cost that a log tells of; null, null and 0 where it does not."""
    found = lambda p: F.when(log.rlike(p), F.regexp_extract(log, p, 1))
    return {"path": found(r"\[EXTRACTION_PATH\]\s*(\S+)"), "chunks": found(r"chunking into\s+([0-9]+)\s+segment").cast("long"), "cost": F.coalesce(found(r"(?i)cost:?\s*\$([0-9]+(?:\.[0-9]+)?)").cast("double"), F.lit(0.0))}


def enriched(posts: DataFrame, url: str, facts: dict[str, Column]) -> DataFrame:
    """Posts with facts about their URL, each URL looked at once."""
    once = posts.dropDuplicates([url]).select(url, *(c.alias(n) for n, c in facts.items()))
    return posts.join(once, url, "left")


def aligned(batch: Column, answers: Column) -> Column:
    """Answers in the order of the pages that were sent: as far as both reach, the page number sent replaces the one told."""
    return F.transform(answers, lambda a, i: F.struct(F.coalesce(F.get(batch, i), a["page_number"]).alias("page_number"), a["score"].alias("score")))


def with_fallback(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """Pages of a first report; where a second has the page too, the second's score stands."""
    other = second.select(*keys, F.col("score").alias("_score"))
    return first.join(other, list(keys), "left").withColumn("score", F.coalesce("_score", "score")).drop("_score")


def coverage(attempted: Column, evaluated: Column) -> Column:
    """Struct of the pages that were sent and not answered, and complete or partial."""
    missing = F.array_except(attempted, evaluated)
    return F.struct(F.sort_array(missing).alias("missing"), F.when(F.size(missing) == 0, "complete").otherwise("partial").alias("state"))
