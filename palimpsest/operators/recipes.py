"""How to convert a file: a recipe from what is known about it, in stages that read what the one before set."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = ("UseHtmlExtraction", "UseClaudeChapters", "UseOCR", "ForceColumns", "NoFootnotes", "NoIndex", "NoBibliography", "NoHyperlinks")

#: Case -> (profile, strategy, flags that are set, whether chapters may be asked for).
CASES = {
    "epub": ("full", ["epub_html", "direct"], (), False),
    "other": ("full", ["direct"], (), False),
    "image": ("text-only", ["ocr"], ("UseOCR", "NoFootnotes", "NoIndex", "NoBibliography", "NoHyperlinks"), False),
    "poor": ("text-only", ["legacy", "ocr"], ("NoFootnotes", "NoIndex", "NoBibliography"), False),
    "moderate": ("clean-read", ["legacy"], ("NoHyperlinks",), True),
    "clean": ("full", ["html_extraction", "legacy"], ("UseHtmlExtraction",), True),
    "garbled": ("full", ["ocr", "gemini", "vision"], ("UseOCR",), False),
    "native": ("full", ["html_extraction", "legacy"], ("UseHtmlExtraction",), True),
    "unknown": ("full", ["html_extraction", "legacy"], ("UseHtmlExtraction",), True),
}


def _pick(case: Column, of) -> Column:  # noqa: ANN001
    out = F.lit(None)
    for name, c in CASES.items():
        out = F.when(case == name, of(c)).otherwise(out)
    return out


def recipes(files: DataFrame) -> DataFrame:
    """files: format, kind, sure (0-1), score (null: 0), common_rate (null: 1), chapters_advised, footnotes, index, links (viability, null where not looked at), two_columns, history (book_history, publisher_profile, another or null), best_score, prior (strategy), prior_chapters, prior_columns.

    Adds case, profile, strategy, flags (map), confidence and reasons.
    """
    score = F.coalesce("score", F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    scanned = F.col("kind").isin("scan_with_text", "scan_no_text")
    case = (
        F.when(F.col("format") == "epub", "epub").when(F.col("format").isin("mobi", "azw", "azw3"), "other").when(F.col("kind") == "scan_no_text", "image")
        .when((F.col("kind") == "scan_with_text") & (score < 50), "poor").when((F.col("kind") == "scan_with_text") & (score < 75), "moderate").when(F.col("kind") == "scan_with_text", "clean")
        .when((F.col("kind") == "digital_native") & (F.coalesce("common_rate", F.lit(1.0)) < 0.05) & (score < 70), "garbled").when(F.col("kind") == "digital_native", "native").otherwise("unknown")
    )
    d = files.withColumn("case", case)
    pdf = ~F.col("case").isin("epub", "other")
    d = d.withColumn("profile", _pick(F.col("case"), lambda c: F.lit(c[0]))).withColumn("strategy", _pick(F.col("case"), lambda c: F.array(*map(F.lit, c[1]))))
    flag = {f: _pick(F.col("case"), lambda c: F.lit(f in c[2])) for f in FLAGS}  # noqa: B023
    flag["UseClaudeChapters"] = _pick(F.col("case"), lambda c: F.lit(c[3])) & yes(F.col("chapters_advised"))
    # What samples of the document itself say stands over the case's defaults.
    seen = pdf & (F.col("kind") != "scan_no_text") & (F.col("footnotes").isNotNull() | F.col("index").isNotNull() | F.col("links").isNotNull())
    notes, index, links = (F.coalesce(c, F.lit("none")) for c in ("footnotes", "index", "links"))
    flag["NoFootnotes"] = F.when(seen, notes.isin("unusable", "none") | ((notes == "degraded") & scanned)).otherwise(flag["NoFootnotes"])
    flag["NoIndex"] = F.when(seen, index != "viable").otherwise(flag["NoIndex"])
    flag["NoBibliography"] = F.when(seen & (index != "viable"), True).otherwise(flag["NoBibliography"])
    flag["NoHyperlinks"] = F.when(seen, links == "none").otherwise(flag["NoHyperlinks"])
    columns = pdf & yes(F.col("two_columns"))
    first = lambda s, c: F.when(c & ~F.array_contains(s, "column_aware"), F.array_insert(s, 1, F.lit("column_aware"))).otherwise(s)
    d = d.withColumn("strategy", first(F.col("strategy"), columns))
    # A good record with this book or publisher stands over all of it.
    proven = pdf & yes(F.col("history").isin("book_history", "publisher_profile") & (F.col("best_score") >= 70) & (F.size("prior") > 0))
    known = pdf & yes(F.col("history").isNotNull() & (F.col("history") != "default"))
    flag["UseClaudeChapters"] = flag["UseClaudeChapters"] | (proven & yes(F.col("prior_chapters")))
    flag["ForceColumns"] = columns | (proven & yes(F.col("prior_columns")))
    d = d.withColumn("strategy", F.when(proven, first(F.col("prior"), yes(F.col("prior_columns")))).otherwise(F.col("strategy")))
    capped = lambda x, c, by: F.when(c, F.least(F.lit(0.95), x + by)).otherwise(x)
    sure = capped(capped(capped(F.coalesce("sure", F.lit(0.0)), seen, 0.05), known, F.when(proven, 0.10).otherwise(0.05)), (score < 30) | (score > 85), 0.05)
    d = d.withColumn("confidence", F.when(F.col("case") == "epub", 0.90).when(F.col("case") == "other", 0.85).otherwise(F.least(F.lit(0.95), F.bround(sure, 2))))
    d = d.withColumn("flags", F.create_map(*(x for k in FLAGS for x in (F.lit(k), flag[k]))))
    return d.withColumn("reasons", F.array_compact(F.array(F.concat(F.lit("case "), F.col("case")), F.when(seen, "sampled"), F.when(columns, "two columns"), F.when(proven, "proven"), F.when(known & ~proven, "history agrees or not"))))


def timeout(size: Column) -> Column:
    """Seconds that a file of so many bytes may take."""
    mb = 1024 * 1024
    return F.when(size < 10 * mb, 120).when(size < 50 * mb, 300).otherwise(600)


def page_budget(size: Column, pages: Column, dpi: Column, most: Column) -> Column:
    """Struct of dpi and pages for a look at a file: less of both for one of over 30 MB or 500 pages."""
    large = (size > 30 * 1024 * 1024) | (pages > 500)
    return F.struct(F.when(large, F.least(dpi, F.lit(72))).otherwise(dpi).alias("dpi"), F.when(large, F.least(most, F.lit(4))).otherwise(most).alias("pages"))


def model_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars by the model's tier."""
    low = F.lower(model)
    rate = lambda a, b: (tokens_in / 1_000_000) * a + (tokens_out / 1_000_000) * b
    return F.when(F.contains(low, F.lit("opus")), rate(5.0, 25.0)).when(F.contains(low, F.lit("haiku")), rate(1.0, 5.0)).otherwise(rate(3.0, 15.0))


def recommended(books: DataFrame, conversions: DataFrame) -> DataFrame:
    """The path for each book and what it rests on: its own conversions, its publisher's with its format (two books or more), its source type's with its format (paths of two conversions or more), or nothing.

    Conversions are summed by book and path once; the wider levels are summed from that. books: book_id, publisher, source_type, format.
    """
    per = conversions.where("score IS NOT NULL").groupBy("book_id", "path").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    best = lambda d, key, *more: d.groupBy(*key).agg(F.max(F.struct((F.col("s") / F.col("n")).alias("mean"), "path")).alias("b"), *more)
    own = best(per, ["book_id"], F.sum("n").alias("n")).select("book_id", F.col("b.path").alias("p1"), F.least(F.lit(95), 50 + 15 * F.col("n")).alias("c1"))
    wide = per.join(books.select("book_id", "publisher", "source_type", "format"), "book_id")
    house = wide.where("publisher IS NOT NULL").groupBy("publisher", "format", "path").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    n_books = wide.where("publisher IS NOT NULL").groupBy("publisher", "format").agg(F.countDistinct("book_id").alias("books"))
    house = best(house, ["publisher", "format"]).join(n_books.where("books >= 2"), ["publisher", "format"]).select("publisher", "format", F.col("b.path").alias("p2"), F.least(F.lit(70), 30 + 10 * F.col("books")).alias("c2"))
    kind = wide.where("source_type IS NOT NULL").groupBy("source_type", "format", "path").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n >= 2")
    kind = best(kind, ["source_type", "format"], F.sum("n").alias("n")).select("source_type", "format", F.col("b.path").alias("p3"), F.least(F.lit(50), 20 + 5 * F.col("n")).alias("c3"))
    d = books.join(own, "book_id", "left").join(house, ["publisher", "format"], "left").join(kind, ["source_type", "format"], "left")
    basis = F.when(F.col("p1").isNotNull(), "book_history").when(F.col("p2").isNotNull(), "publisher_profile").when(F.col("p3").isNotNull(), "source_type_profile").otherwise("default")
    return d.select("book_id", F.coalesce("p1", "p2", "p3").alias("path"), F.coalesce("c1", "c2", "c3", F.lit(0)).cast("long").alias("sure"), basis.alias("basis"))


def fallback_pages(pages: DataFrame, high: int = 80, phrases: tuple[str, ...] = (), least: int = 3, share: float = 0.75, ceilings: dict[str, int] | None = None) -> DataFrame:
    """pages: batch, page_number, page_type, score, issues (description, severity). Pages that look made up, and by which test.

    A batch without any issue and with one high score is flagged as a whole (3); else a page with no issues and a high score (1), with a known phrase (2), at
    the score that most pages of its batch have (4), or above its type's ceiling without a grave issue (5).
    """
    score, issues = F.coalesce("score", F.lit(0)), F.coalesce("issues", F.array())
    none = F.size(issues) == 0
    batch = pages.groupBy("batch").agg(F.bool_and(F.size(F.coalesce("issues", F.array())) == 0).alias("_empty"), F.max(score).alias("_top"))
    # Of scores that are equally common the one met first counts.
    counts = pages.where("score IS NOT NULL").groupBy("batch", "score").agg(F.count(F.lit(1)).alias("n"), F.min("page_number").alias("first"))
    most = counts.groupBy("batch").agg(F.sum("n").alias("_scored"), F.max(F.struct("n", (-F.col("first")).alias("first"), "score")).alias("_t"))
    d = pages.join(batch, "batch").join(most, "batch", "left")
    phrase = F.exists(issues, lambda i: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(i["description"]), p))) if phrases else F.lit(False)
    same = (F.col("_t.n") >= least) & (F.col("_t.n") >= share * F.col("_scored")) & (F.col("score") == F.col("_t.score"))
    ceiling = F.create_map(*(F.lit(x) for kv in (ceilings or {"": 0}).items() for x in kv))[F.col("page_type")]
    grave = F.exists(issues, lambda i: F.coalesce(i["severity"], F.lit("minor")).isin("critical", "major", "moderate"))
    test = F.when(F.col("_empty") & (F.col("_top") >= high), 3).when(none & (score >= high), 1).when(F.coalesce(phrase, F.lit(False)), 2).when(F.coalesce(same, F.lit(False)), 4).when(F.coalesce((score > ceiling) & ~grave, F.lit(False)), 5)
    return d.withColumn("test", test).where("test IS NOT NULL").select("batch", "page_number", "test")


ALL_PATHS = ("html_extraction", "legacy", "column_aware")
TOC_LEAST = 60  # a table of contents that scores less asks for chapters


def recommendations(books: DataFrame, conversions: DataFrame, issues: DataFrame) -> DataFrame:
    """What to try for each book, in order, and why: paths, flags, sure (percent), reason, basis, best_prior_score, prior_conversions.

    From the book's own scored conversions: its paths by mean score (ties: by the best, then by name). Else from its publisher's with its format, of two books or more: the best path, then the others. Else from its source type's
    with its format: paths of two conversions or more by mean score. Chapters are asked for if the book has none, if the contents of its best conversion scored low, or if contents are among its publisher's five most common issues;
    columns are forced if the column path won. books: book_id, publisher, source_type, format, chapter_count; conversions: book_id, path, score, toc (null: not scored); issues: book_id, category.
    """
    scored = conversions.where("score IS NOT NULL")
    ranked = lambda d, key: d.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("s") / F.col("n")).alias("mean"), (-F.col("best")).alias("best"), "path", "n"))), lambda x: F.struct(x["path"].alias("path"), (-x["mean"]).alias("mean"), x["n"].alias("n"))).alias("r"), F.sum("n").alias("n"))  # noqa: E731  a row for each path
    per = scored.groupBy("book_id", "path").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    top = scored.groupBy("book_id").agg(F.max(F.struct("score", F.coalesce("toc", F.lit(100)).alias("toc"))).alias("t"))
    own = ranked(per, ["book_id"]).join(top, "book_id").select("book_id", F.col("r").alias("r1"), F.col("n").alias("n1"), F.col("t.score").alias("best_prior_score"), F.col("t.toc").alias("toc"))
    wide = per.join(books.select("book_id", "publisher", "source_type", "format"), "book_id")
    key2, key3 = ["publisher", "format"], ["source_type", "format"]
    sums = lambda d, key: d.groupBy(*key, "path").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("best").alias("best"))
    house = wide.where("publisher IS NOT NULL")
    of_house = house.groupBy(*key2).agg(F.countDistinct("book_id").alias("books"), (F.sum("s") / F.sum("n")).alias("mean2")).where("books >= 2")
    common = issues.join(books.where("publisher IS NOT NULL").select("book_id", *key2), "book_id").groupBy(*key2, "category").agg(F.count(F.lit(1)).alias("n")).groupBy(*key2).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))), 1, 5).alias("c"))
    house = ranked(sums(house, key2), key2).select(*key2, F.col("r").alias("r2")).join(of_house, key2).join(common, key2, "left").select(*key2, "r2", "books", "mean2", F.coalesce(F.exists("c", lambda x: x["category"] == "toc_navigation"), F.lit(False)).alias("toc2"))
    kind = ranked(sums(wide.where("source_type IS NOT NULL"), key3).where("n >= 2"), key3).select(*key3, F.col("r").alias("r3"), F.col("n").alias("n3"))
    d = books.join(own, "book_id", "left").join(house, key2, "left").join(kind, key3, "left")
    level = F.when(F.col("r1").isNotNull(), 1).when(F.col("r2").isNotNull(), 2).when(F.col("r3").isNotNull(), 3).otherwise(4)
    first = lambda r: F.get(r, F.lit(0))
    whole = lambda x: F.bround(x).cast("long").cast("string")
    names = lambda r: F.transform(r, lambda x: x["path"])
    rest = F.array_union(F.array(first("r2")["path"]), F.array(*map(F.lit, ALL_PATHS)))
    chapters = F.when(level == 1, (F.coalesce("chapter_count", F.lit(0)) == 0) | (F.col("toc") < TOC_LEAST)).when(level == 2, F.col("toc2")).otherwise(False)
    columns = (level == 1) & (first("r1")["path"] == "column_aware")
    second = F.when(F.size("r1") > 1, F.concat(F.lit("; vs "), F.get("r1", F.lit(1))["path"], F.lit(" avg "), whole(F.get("r1", F.lit(1))["mean"]))).otherwise("")
    reason = F.when(level == 1, F.concat(first("r1")["path"], F.lit(" scored avg "), whole(first("r1")["mean"]), second, F.when(chapters, "; no chapters detected in prior runs").otherwise("")))
    reason = reason.when(level == 2, F.concat("publisher", F.lit(" books avg "), whole(F.col("mean2")), F.lit(" with "), first("r2")["path"], F.lit(" ("), F.col("books").cast("string"), F.lit(" books)")))
    reason = reason.when(level == 3, F.concat("source_type", F.lit(" PDFs avg "), whole(first("r3")["mean"]), F.lit(" with "), first("r3")["path"], F.lit(" ("), first("r3")["n"].cast("string"), F.lit(" conversions)"))).otherwise("no historical data available")
    sure = F.when(level == 1, F.least(F.lit(95), 50 + 15 * F.col("n1"))).when(level == 2, F.least(F.lit(70), 30 + 10 * F.col("books"))).when(level == 3, F.least(F.lit(50), 20 + 5 * F.col("n3"))).otherwise(0)
    paths = F.when(level == 1, names("r1")).when(level == 2, rest).when(level == 3, names("r3")).otherwise(F.array().cast("array<string>"))
    basis = F.get(F.array(*map(F.lit, ("book_history", "publisher_profile", "source_type_profile", "default"))), level - 1)
    return d.select("book_id", paths.alias("paths"), F.coalesce(chapters, F.lit(False)).alias("UseClaudeChapters"), F.coalesce(columns, F.lit(False)).alias("ForceColumns"), sure.cast("long").alias("sure"), reason.alias("reason"), basis.alias("basis"), "best_prior_score", F.coalesce("n1", F.lit(0)).cast("long").alias("prior_conversions"))
