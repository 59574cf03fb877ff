"""Diagnostics of converted books: failure patterns, status, clusters, correlations, reports and deltas between runs.

A diagnostics row has one column for each measure; null stands for one that was not taken.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import once
from ..functions.text import penalties, segment_score
from .classify import detect_issues

#: Words that tell back matter.
BACK_MATTER = ("notes", "bibliography", "index", "references", "appendix", "appendices", "glossary", "further reading", "suggested reading", "about the author", "acknowledgments", "acknowledgements", "works cited", "endnotes", "select bibliography", "selected bibliography", "source notes", "permissions", "credits", "colophon")

#: Pattern -> (severity, condition), in order.
PATTERNS = {
    "CHAPTER_DETECTION_ZERO": ("high", "chapter_count = 0"),
    "CHAPTER_DETECTION_BACKMATTER_ONLY": ("high", "coalesce(only_backmatter, false)"),
    "LIGATURE_SPLITS_HIGH": ("medium", "ligature_splits > 20"),
    "FOOTNOTES_UNLINKED": ("medium", "footnotes_unlinked > 10 AND footnotes_linked = 0"),
    "VQA_SCORE_LOW": ("high", "vqa_attempted AND vqa_score < 65"),
    "EXTRACTION_FAILED": ("critical", "NOT extraction_success"),
    "KFX_FAILED": ("high", "coalesce(kfx_attempted, false) AND NOT coalesce(kfx_success, true)"),
    "PAGE_NUMBERS_PRESENT": ("low", "coalesce(page_numbers, 0) > 5"),
    "NO_FORMATTING_PRESERVED": ("medium", "coalesce(italic_tags, 0) = 0 AND coalesce(bold_tags, 0) = 0 AND coalesce(word_count, 0) > 10000"),
    "DOUBLE_SPACES": ("low", "coalesce(double_spaces, 0) > 20"),
    "LIKELY_SCAN_NO_OCR": ("medium", "source_type = 'scan' AND word_count < 100"),
    "DRM_ENCRYPTED": ("medium", "lower(errors) LIKE '%encrypt%' OR lower(errors) LIKE '%password%'"),
    "MULTI_SCRIPT_NO_VISION": ("info", "coalesce(has_non_latin, false) AND coalesce(non_latin_pct, 0) > 5 AND coalesce(extraction_path, '') <> 'claude_vision'"),
    "MULTI_COLUMN_NOT_ROUTED": ("low", "column_confidence >= 0.3 AND column_confidence < 0.6 AND word_count > 5000"),
    "TEXT_LAYER_LOW_QUALITY": ("high", "coalesce(text_layer_score, 100) < 50 AND word_count > 100"),
    "TEXT_LAYER_BORDERLINE": ("medium", "coalesce(text_layer_score, 100) >= 50 AND coalesce(text_layer_score, 100) < 75 AND word_count > 100"),
    "ENCODING_FIXED": ("info", "coalesce(encoding_fixes, 0) > 10"),
}
RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def backmatter_only(labels: Column) -> Column:
    """True for headings of which every one names back matter; false for none at all."""
    named = lambda label: F.exists(F.array(*map(F.lit, BACK_MATTER)), lambda k: F.contains(F.lower(label), k))
    return F.coalesce((F.size(labels) > 0) & F.forall(labels, named), F.lit(False))


def source_type(source: Column, word_count: Column, file_size: Column) -> Column:
    """A large file with hardly a word is a scan."""
    return F.when((word_count < 100) & (file_size > 5 * 1024 * 1024), "scan").otherwise(source)


def diagnose(diags: DataFrame) -> DataFrame:
    """diags with issues (pattern, severity), status and reason."""
    d = diags.withColumn("issues", detect_issues({k: (F.expr(c), s) for k, (s, c) in PATTERNS.items()}))
    has = lambda s: F.exists("issues", lambda x: x["severity"] == s)
    limit = F.coalesce("vqa_threshold", F.lit(70))
    scored = F.coalesce("vqa_attempted", F.lit(False)) & F.col("vqa_score").isNotNull()
    way_below, below = scored & (F.col("vqa_score") < limit - 10), scored & (F.col("vqa_score") < limit)
    d = d.withColumn("status", F.when(~F.col("extraction_success"), "ERROR").when(has("critical") | way_below, "FAIL").when(has("high") | below, "WARN").otherwise("PASS"))
    return d.withColumn("reason", F.when(F.col("status") == "ERROR", "failed").when(has("critical"), "critical").when(way_below, "score far below").when(has("high"), F.array_join(F.slice(F.transform(F.filter("issues", lambda x: x["severity"] == "high"), lambda x: x["pattern"]), 1, 2), "; ")).when(below, "score below").otherwise("passed"))


def clusters(diagnosed: DataFrame) -> DataFrame:
    """A row for each pattern that any book has: severity, rank, number of books, and how many by source type and format (maps). Books themselves: cluster_books."""
    d = diagnosed.select("source_type", "format", F.explode("issues").alias("i")).select("source_type", "format", "i.pattern", "i.severity")
    each = d.groupBy("pattern", "severity", "source_type", "format").agg(F.count(F.lit(1)).alias("n"))
    by = lambda c: each.groupBy("pattern", c).agg(F.sum("n").alias("n")).groupBy("pattern").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("severity")], F.lit(9))
    total = each.groupBy("pattern", "severity").agg(F.sum("n").alias("n_books"))
    return total.join(by("source_type"), "pattern").join(by("format"), "pattern").withColumn("rank", rank)


def cluster_books(diagnosed: DataFrame) -> DataFrame:
    """pattern, filename: the books of each cluster."""
    return diagnosed.select(F.explode("issues").alias("i"), "filename").select("i.pattern", "filename")


def correlations(diagnosed: DataFrame) -> DataFrame:
    """Observations over the whole batch: kind, what, share in percent and count. One aggregate by source type, then one row."""
    failed = F.col("status").isin("FAIL", "ERROR")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    chapters = F.exists("issues", lambda x: x["pattern"] == "CHAPTER_DETECTION_ZERO")
    large = failed & (F.col("file_size") > 10 * 1024 * 1024)
    low = F.coalesce(F.col("vqa_attempted") & (F.col("vqa_score") < 60), F.lit(False))
    d = diagnosed.groupBy("source_type").agg(F.count(F.lit(1)).alias("total"), n(failed).alias("failed"), n(chapters).alias("chapters"), n(large).alias("large"), n(low).alias("low"))
    d = d.agg(F.sum("total").alias("total"), F.sum("failed").alias("failed"), F.sum("chapters").alias("chapters"), F.sum("large").alias("large"), F.sum("low").alias("low"), F.sort_array(F.collect_list(F.struct((-F.col("failed")).alias("n"), F.col("source_type").alias("what")))).alias("types"))
    row = lambda c, kind, what, share, count: F.when(c, F.struct(F.lit(kind).alias("kind"), what.cast("string").alias("what"), F.round(share, 1).alias("share"), count.cast("long").alias("n")))
    percent = lambda x, of: x * 100.0 / F.greatest(of, F.lit(1))
    top = F.transform(F.slice("types", 1, 3), lambda t: row((t["what"] != "unknown") & (-t["n"] >= 2) & (percent(-t["n"], F.col("failed")) >= 75), "source type", t["what"], percent(-t["n"], F.col("failed")), -t["n"]))
    rest = F.array(
        row(percent(F.col("chapters"), F.col("total")) >= 15, "no chapters", F.lit(None), percent(F.col("chapters"), F.col("total")), F.col("chapters")),
        row((F.col("large") >= 2) & (F.col("large") >= 0.5 * F.col("failed")), "large files", F.lit(None), percent(F.col("large"), F.col("failed")), F.col("large")),
        row(F.col("low") >= 2, "low scores", F.lit(None), percent(F.col("low"), F.col("total")), F.col("low")),
    )
    return d.select(F.explode(F.array_compact(F.concat(top, rest))).alias("o")).select("o.*")


def summary(diagnosed: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, cost, and both pass rates: of all books, and of those not skipped."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    d = diagnosed.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"), n("ERROR").alias("errored"), n("SKIP").alias("skipped"), F.sum(F.coalesce("cost_cents", F.lit(0))).alias("cost_cents"))
    return d.withColumn("pass_rate", F.bround(F.col("passed") * 100 / F.greatest("total", F.lit(1)), 1)).withColumn("pass_rate_run", F.bround(F.col("passed") * 100 / F.greatest(F.col("total") - F.col("skipped"), F.lit(1)), 1))


def json_report(diagnosed: DataFrame) -> DataFrame:
    """The report's head as JSON: summary, and clusters in their order (at most one row for each pattern). Books stay a table."""
    top = clusters(diagnosed).agg(F.sort_array(F.collect_list(F.struct("rank", (-F.col("n_books")).alias("fewer"), "pattern", "severity", "n_books", F.map_entries("by_source_type").alias("s"), F.map_entries("by_format").alias("f")))).alias("c"))
    shown = F.transform("c", lambda x: F.struct(x["pattern"].alias("pattern_id"), x["severity"].alias("severity"), x["n_books"].alias("book_count"), F.map_from_entries(x["s"]).alias("source_types"), F.map_from_entries(x["f"]).alias("formats")))
    s = summary(diagnosed)
    s = s.select(F.struct(*(F.col(c).alias(f"books_{c}") for c in ("total", "passed", "warned", "failed", "errored", "skipped")), (F.col("cost_cents") / 100).alias("total_cost")).alias("summary"))
    return s.crossJoin(F.broadcast(top)).select(F.to_json(F.struct("summary", shown.alias("failure_clusters"))).alias("report"))  # one row beside one row


def markdown_lines(diagnosed: DataFrame) -> DataFrame:
    """The numbers of the written report, a line each."""
    s = summary(diagnosed)
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), value.cast("string"))
    return s.select(F.posexplode(F.array(line("Books", F.col("total")), line("Passed", F.col("passed")), line("Warned", F.col("warned")), line("Failed", F.col("failed")), line("Errors", F.col("errored")), line("Skipped", F.col("skipped")), line("Pass rate without skipped", F.col("pass_rate_run")))).alias("place", "line"))


def run_deltas(diagnosed: DataFrame, old: int, new: int) -> DataFrame:
    """Counts of two runs: metric, both values, difference, and whether it is for the better (1), worse (-1) or neither (0)."""
    s = summary(diagnosed.where(F.col("run").isin(old, new)), "run")
    better = {"total": 1, "passed": 1, "warned": -1, "failed": -1, "errored": -1, "pass_rate": 1}
    rows = s.select("run", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.lit(v).alias("sign"), F.col(k).cast("double").alias("value")) for k, v in better.items()))).alias("m")).select("run", "m.*")
    both = rows.groupBy("metric", "sign").agg(F.coalesce(F.max(F.when(F.col("run") == old, F.col("value"))), F.lit(0.0)).alias("old"), F.coalesce(F.max(F.when(F.col("run") == new, F.col("value"))), F.lit(0.0)).alias("new"))
    return both.select("metric", "old", "new", (F.col("new") - F.col("old")).alias("change"), (F.signum(F.col("new") - F.col("old")) * F.col("sign")).cast("int").alias("direction"))


def cluster_deltas(diagnosed: DataFrame, old: int, new: int) -> DataFrame:
    """Books by pattern in two runs; one that lacks a pattern counts 0."""
    d = diagnosed.where(F.col("run").isin(old, new)).select("run", F.explode("issues").alias("i"))
    n = lambda r: F.sum(F.when(F.col("run") == r, 1).otherwise(0))
    return d.groupBy(F.col("i.pattern").alias("pattern")).agg(n(old).alias("n_old"), n(new).alias("n_new")).withColumn("change", F.col("n_new") - F.col("n_old"))


#: Where in a text the five samples lie.
PLACES = (0.10, 0.25, 0.50, 0.75, 0.90)


def quality_variance(text: Column) -> Column:
    """Scores of five samples of a text, mean, population deviation and the worst place; null under 2500 characters."""
    n = F.length(text)
    window = F.least(F.lit(2000), F.floor(n / 6).cast("int"))

    def score(p: float) -> Column:
        start = F.greatest(F.lit(0), F.floor(n * F.lit(p)).cast("int") - F.floor(window / 2).cast("int"))

        def judged(sample: Column) -> Column:
            m = penalties(sample)
            return segment_score(m["n_replaced"], m["n_ligatures"], m["n_doubles"], m["n_controls"], F.length(sample))

        return once(F.substring(text, start + 1, window), judged)

    def told(s: Column) -> Column:
        mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / len(PLACES)
        spread = F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / len(PLACES))
        worst = F.get(F.array(*map(F.lit, PLACES)), (F.array_position(s, F.array_min(s)) - 1).cast("int"))
        return F.struct(s.alias("scores"), F.bround(mean, 1).alias("mean"), F.bround(spread, 1).alias("std_dev"), (spread > 15).alias("high_variance"), worst.alias("worst_position"), F.array_min(s).alias("worst_score"), F.array_max(s).alias("best_score"))

    return F.when(n >= 2500, F.get(F.transform(F.array(F.array(*map(score, PLACES))), told), F.lit(0)))
