"""Reports held against each other and against what was asked: parity by book, guards, summaries, corrections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exit codes by what was found, the gravest first.
INFRASTRUCTURE = ("load_error", "schema_error", "conversion_error")


def book_audit(reports: DataFrame, outputs: DataFrame) -> DataFrame:
    """reports: book, pages (array, null if it cannot be read), valid; outputs: book, pages. parity, mismatch or skipped, and why."""
    d = reports.join(outputs.select("book", F.col("pages").alias("_now"), F.lit(True).alias("_there")), "book", "left")
    why = F.when(F.col("pages").isNull(), "load_error").when(~F.col("valid"), "schema_error").when(F.col("_there").isNull(), "no_matching_output").when(F.col("_now").isNull(), "conversion_error")
    same = F.sort_array("pages") == F.sort_array("_now")
    return d.select("book", F.when(why.isNotNull(), "skipped").when(same, "parity").otherwise("mismatch").alias("status"), why.alias("skip_reason"))


def exit_code(audit: DataFrame) -> DataFrame:
    """One row: 3 for an error of the surroundings, 2 for a mismatch, 1 for a book without output, 0 for parity."""
    code = F.when(F.col("skip_reason").isin(*INFRASTRUCTURE), 3).when(F.col("status") == "mismatch", 2).when(F.col("skip_reason") == "no_matching_output", 1).otherwise(0)
    return audit.agg(F.coalesce(F.max(code), F.lit(0)).alias("code"))


def guards(sent: Column, answered: Column) -> Column:
    """What is wrong with an answer for pages that were sent: their number, or labels of pages that were not."""
    return F.array_compact(F.array(F.when(F.size(sent) != F.size(answered), "page count"), F.when(F.size(F.array_except(answered, sent)) > 0, "unknown page")))


#: What a report's pages may hold.
CATEGORIES = ("text_integrity", "heading_formatting", "paragraph_flow", "toc_navigation", "cover_images", "page_layout")
SEVERITIES = ("critical", "major", "moderate", "minor")
PAGE_TYPES = ("cover", "toc", "front_matter", "chapter_start", "body", "back_matter")
ISSUE = "struct<category: string, severity: string, description: string, suggestion: string>"


def schema_faults(text: Column) -> Column:
    """What of an answer's JSON does not fit a report's schema: json, pages, or the names of fields that are missing or hold what they may not, each once, in the schema's order."""
    pages = F.get_json_object(text, "$.pages")
    read = F.from_json(text, f"struct<pages: array<struct<page_number: long, page_type: string, score: double, pass: boolean, issues: array<{ISSUE}>>>>")["pages"]
    issues = F.flatten(F.transform(read, lambda p: F.coalesce(p["issues"], F.array().cast(f"array<{ISSUE}>"))))
    any_page = lambda bad: F.exists(read, lambda p: F.coalesce(bad(p), F.lit(True)))
    any_issue = lambda bad: F.exists(issues, lambda i: F.coalesce(bad(i), F.lit(True)))
    faults = {
        "page_number": any_page(lambda p: p["page_number"] < 1), "page_type": any_page(lambda p: ~p["page_type"].isin(*PAGE_TYPES)), "category": any_issue(lambda i: ~i["category"].isin(*CATEGORIES)), "severity": any_issue(lambda i: ~i["severity"].isin(*SEVERITIES)),
        "description": any_issue(lambda i: i["description"].isNull()), "suggestion": any_issue(lambda i: i["suggestion"].isNull()), "score": any_page(lambda p: (p["score"] < 0) | (p["score"] > 100)), "pass": any_page(lambda p: p["pass"].isNull()), "issues": any_page(lambda p: p["issues"].isNull()),
    }
    named = F.array_compact(F.array(*(F.when(bad, name) for name, bad in faults.items())))
    return F.when(F.coalesce(F.get_json_object(text, "$").isNull(), F.lit(True)), F.array(F.lit("json"))).when(pages.isNull() | read.isNull(), F.array(F.lit("pages"))).otherwise(named)


def readable(rows: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that can be read, and the others as errors."""
    fine = F.coalesce(good, F.lit(False))
    return rows.where(fine), rows.where(~fine)


def report_heads(pages: DataFrame, threshold: int = 70) -> DataFrame:
    """pages: book, page, score (null if not evaluated), tokens_in, tokens_out. A report's head: mean score of what was evaluated, null if nothing was; whether it passes; complete or partial; cost."""
    d = pages.groupBy("book").agg(F.count(F.lit(1)).alias("attempted"), F.count("score").alias("evaluated"), F.avg("score").alias("score"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return d.select("book", "attempted", "evaluated", F.bround("score").cast("long").alias("score"), (F.bround("score") >= threshold).alias("passed"), F.when(F.col("evaluated") == F.col("attempted"), "complete").otherwise("partial").alias("state"), (F.col("tokens_in") * 3.0 / 1_000_000 + F.col("tokens_out") * 15.0 / 1_000_000).alias("cost"))


def corrections(overrides: DataFrame) -> DataFrame:
    """overrides: book_id, corrections_json. A row for each correction; text that is no list gives none."""
    d = overrides.withColumn("c", F.from_json("corrections_json", "array<struct<old: string, new: string>>"))
    return d.select("book_id", F.explode("c").alias("c")).select("book_id", "c.old", "c.new")


def updated(overrides: DataFrame, changes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Overrides after changes (id and any columns): only allowed columns change, where the change has a value."""
    known = [c for c in changes.columns if c in allowed and c in overrides.columns]
    new = changes.select("id", *(F.col(c).alias(f"_{c}") for c in known))
    return overrides.join(new, "id", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in known else F.col(c) for c in overrides.columns))


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct runs of `size` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size) if isinstance(size, int) else size)))


def found_by_name(wanted: DataFrame, books: DataFrame) -> DataFrame:
    """wanted: name. The newest book of exactly that name, else the newest whose title holds it, whatever its case. One row for each wanted name that is found; an empty or null name finds nothing.

    A name meets titles at one of its runs of three characters (the whole name, if it is shorter), the one that the fewest titles have; what meets is then looked through.
    """
    asked = wanted.select("name").where(F.length("name") > 0).distinct()
    exact = asked.join(books, F.col("name") == F.col("title")).groupBy("name").agg(F.max("book_id").alias("book_id")).withColumn("way", F.lit(0))
    rest = asked.join(exact.select("name"), "name", "left_anti").withColumn("low", F.lower("name"))
    titles = books.select("book_id", F.lower("title").alias("title"))
    runs = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.when(F.length("title") >= k, _grams(F.col("title"), k)).otherwise(F.array().cast("array<string>"))))
    by_run = titles.select("book_id", "title", F.explode(runs).alias("run"))
    common = by_run.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    own = rest.select("name", "low", F.explode(_grams(F.col("low"), F.least(F.lit(3), F.length("low")))).alias("run"))
    rarest = own.join(common, "run", "left").groupBy("name", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("x")).where("x.n > 0").select("name", "low", F.col("x.run").alias("run"))
    like = rarest.join(by_run, "run").where(F.contains("title", "low")).groupBy("name").agg(F.max("book_id").alias("book_id")).withColumn("way", F.lit(1))
    return exact.unionByName(like)
