"""Written reports of a batch: rows of sections that render as Markdown or as a page.

A report is a table of section, key (the order within the section), kind and cells, one row a line, so a batch of any size is written by as many tasks as it has parts; sort by section and key when
the lines are put into one file. Sections: 1 head, 2 failure clusters, 3 observations, 4 distribution of scores, 5 books, 6 books of uneven quality, 7 earlier runs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lines import once
from . import diagnostics as D

SHOWN, NAME = 5, 45  # files named in a cluster, characters of a name
BUCKETS = ((90, 100), (80, 89), (70, 79), (60, 69), (0, 59))
ROWS = ["section", "key", "kind", "cells"]


def _line(section: int, key: Column, kind: str, *cells: Column) -> Column:
    """A row, null if a cell is."""
    put = lambda filled: F.when(~F.exists(filled, lambda c: c.isNull()), F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), F.lit(kind).alias("kind"), filled.alias("cells")))
    return once(F.array(*(c.cast("string") for c in cells)), put)


def _rows(d: DataFrame, *lines: Column) -> DataFrame:
    return d.select(F.explode(F.array_compact(F.array(*lines))).alias("r")).select("r.*")


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def named(name: Column) -> Column:
    """A name cut to NAME characters."""
    return F.when(F.length(name) > NAME, F.concat(F.substring(name, 1, NAME - 3), F.lit("..."))).otherwise(name)


def _scored() -> Column:
    return F.when(F.coalesce("vqa_attempted", F.lit(False)), F.col("vqa_score"))


def head(diagnosed: DataFrame, run: str) -> DataFrame:
    s = diagnosed.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == x).alias(x) for x in ("PASS", "WARN", "FAIL", "ERROR")), F.sum(F.coalesce("cost_cents", F.lit(0))).alias("cents"), F.count(_scored()).alias("n"), F.avg(_scored()).alias("mean"), F.min(_scored()).alias("low"), F.max(_scored()).alias("high"))
    counts = _said("Books processed: ", F.col("total"), " | Passed: ", F.col("PASS"), " | Warnings: ", F.col("WARN"), " | Failed: ", F.col("FAIL"), " | Errors: ", F.col("ERROR"))
    cost = _said("API cost: $", F.format_string("%.2f", F.col("cents") / 100))
    visual = F.when(F.col("n") > 0, _said("Visual QA: ", F.col("n"), " scored | avg ", F.format_string("%.1f", F.bround("mean", 1)), " | range ", F.col("low"), "-", F.col("high")))
    return _rows(s, _line(1, F.lit("0"), "title", F.lit(f"Batch report {run}")), _line(1, F.lit("1"), "text", counts), _line(1, F.lit("2"), "text", cost), _line(1, F.lit("3"), "text", visual))


def cluster_section(diagnosed: DataFrame) -> DataFrame:
    """Each failure pattern: how many books, the first files, source types by how common they are, patterns that hold all its books too, its impact."""
    total = diagnosed.agg(F.count(F.lit(1)).alias("total"))
    books = diagnosed.select("filename", "source_type", F.transform("issues", lambda i: i["pattern"]).alias("patterns"), F.explode_outer("issues").alias("i")).select("filename", "source_type", "patterns", "i.pattern", "i.severity").where("pattern IS NOT NULL")  # outer: no filter that repeats how issues are found
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in D.RANK.items() for x in kv))[F.col("severity")], F.lit(9))
    sizes = books.groupBy("pattern", "severity").agg(F.count(F.lit(1)).alias("n"))
    first = books.withColumn("place", F.row_number().over(W.partitionBy("pattern").orderBy("filename"))).where(F.col("place") <= SHOWN).groupBy("pattern").agg(F.array_join(F.sort_array(F.collect_list("filename")), ", ").alias("shown"))
    types = books.groupBy("pattern", "source_type").agg(F.count(F.lit(1)).alias("n")).groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "source_type"))).alias("t"))
    told = F.when(F.exists("t", lambda x: x["source_type"] != "unknown"), F.array_join(F.transform("t", lambda x: _said(x["source_type"], " (", -x["n"], ")")), ", "))
    both = books.select("pattern", F.explode_outer("patterns").alias("other")).where("pattern <> other").groupBy("pattern", "other").agg(F.count(F.lit(1)).alias("both"))
    whole = both.join(sizes.select("pattern", "n"), "pattern").where("both = n AND n >= 2").groupBy("pattern").agg(F.array_join(F.sort_array(F.collect_list("other")), ", ").alias("also"))
    d = sizes.join(first, "pattern").join(types.select("pattern", told.alias("types")), "pattern").join(whole, "pattern", "left").crossJoin(F.broadcast(total))  # a row for each pattern, beside one row
    key = lambda k: F.concat(rank.cast("string"), F.lpad((F.lit(10**12) - F.col("n")).cast("string"), 13, "0"), F.col("pattern"), F.lit(f" {k}"))
    more = F.when(F.col("n") > SHOWN, _said("(+", F.col("n") - SHOWN, " more)"))
    impact = F.when(F.col("n") >= F.col("total") * 0.15, _said("Impact: Affects ", F.bround(F.col("n") * 100 / F.col("total")).cast("long"), "% of all books in this batch."))
    return _rows(
        d, _line(2, key(0), "heading", _said(F.upper("severity"), " - ", F.col("pattern"), " (", F.col("n"), " books)")), _line(2, key(1), "text", _said("Affected: ", F.col("shown"))), _line(2, key(2), "text", more),
        _line(2, key(3), "text", _said("Source types: ", F.col("types"))), _line(2, key(4), "text", _said("All also in: ", F.col("also"))), _line(2, key(5), "text", impact),
    )


def observation_section(diagnosed: DataFrame) -> DataFrame:
    o = D.correlations(diagnosed)
    return _rows(o, _line(3, F.concat("kind", F.lit(" "), F.coalesce("what", F.lit(""))), "item", _said(F.col("kind"), F.coalesce(F.concat(F.lit(" "), "what"), F.lit("")), ": ", F.format_string("%.1f", "share"), "% (", F.col("n"), ")")))


def score_section(diagnosed: DataFrame) -> DataFrame:
    s = _scored()
    of = [F.count_if(s.between(low, high)).alias(f"b{k}") for k, (low, high) in enumerate(BUCKETS)]
    d = diagnosed.agg(*of, F.count(s).alias("n"), F.count(F.lit(1)).alias("total")).where("n > 0")
    rows = [_line(4, F.lit(str(k)), "row", F.lit(f"{low}-{high}"), F.when(F.col(f"b{k}") > 0, F.col(f"b{k}"))) for k, (low, high) in enumerate(BUCKETS)]
    return _rows(d, *rows, _line(4, F.lit(str(len(BUCKETS))), "row", F.lit("No VQA"), F.when(F.col("total") > F.col("n"), F.col("total") - F.col("n"))))


def book_section(diagnosed: DataFrame) -> DataFrame:
    chapters = F.when(F.col("extraction_success"), F.col("chapter_count").cast("string")).otherwise("-")
    return _rows(diagnosed, _line(5, F.col("filename"), "row", named(F.col("filename")), F.col("status"), F.coalesce(chapters, F.lit("-")), F.size("issues")))


def uneven_section(varied: DataFrame) -> DataFrame:
    """varied: filename and v, of diagnostics.quality_variance()."""
    v = F.col("v")
    said = _said(named(F.col("filename")), ": std_dev=", v["std_dev"], ", mean=", v["mean"], ", worst section at ", F.floor(v["worst_position"] * 100).cast("long"), "%")
    return _rows(varied.where(v["high_variance"]), _line(6, F.col("filename"), "item", said))


def run_section(runs: DataFrame) -> DataFrame:
    """runs: run_id, total, passed, pass_rate."""
    return _rows(runs, _line(7, F.col("run_id"), "row", F.col("run_id"), F.col("total"), F.col("passed"), F.format_string("%.1f", "pass_rate")))


def report(diagnosed: DataFrame, run: str, varied: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    out = head(diagnosed, run)
    parts = [cluster_section(diagnosed), observation_section(diagnosed), score_section(diagnosed), book_section(diagnosed)]
    for d in parts + [f(x) for f, x in ((uneven_section, varied), (run_section, runs)) if x is not None]:
        out = out.unionByName(d)
    return out


def markdown(rows: DataFrame) -> DataFrame:
    """section, key, line."""
    cells = F.transform("cells", lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    plain = F.get("cells", F.lit(0))
    line = F.when(F.col("kind") == "title", F.concat(F.lit("# "), plain)).when(F.col("kind") == "heading", F.concat(F.lit("### "), plain)).when(F.col("kind") == "item", F.concat(F.lit("- "), plain)).when(F.col("kind") == "row", F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))).otherwise(F.concat(plain, F.lit("  ")))
    return rows.select("section", "key", line.alias("line"))


def html(rows: DataFrame) -> DataFrame:
    """section, key, line; text is escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    plain = safe(F.get("cells", F.lit(0)))
    inside = lambda tag: F.concat(F.lit(f"<{tag}>"), plain, F.lit(f"</{tag}>"))
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda c: F.concat(F.lit("<td>"), safe(c), F.lit("</td>"))), ""), F.lit("</tr>"))
    return rows.select("section", "key", F.when(F.col("kind") == "title", inside("h1")).when(F.col("kind") == "heading", inside("h3")).when(F.col("kind") == "item", inside("li")).when(F.col("kind") == "row", row).otherwise(inside("p")).alias("line"))


def write(rows: DataFrame, path: str, form: str = "markdown") -> None:
    """The lines as text in as many files as there are parts, in order."""
    lines = markdown(rows) if form == "markdown" else html(rows)
    lines.repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("line").write.mode("overwrite").text(path)
