"""Pages, their images and sections; comparisons of runs and baselines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lines import latest, once
from ..functions.text import WHITE, count_of, penalties, word_count
from .diagnostics import backmatter_only, quality_variance

#: Tolerances of the baseline's measures.
HEADING_TOLERANCE, TOC_TOLERANCE, OUTPUT_TOLERANCE = 2, 5, 10
#: Shares above which back matter and index are viable or degraded.
NOTES, INDEX = (0.80, 0.50), (0.50, 0.25)


def sample_places(total: Column, n: int = 10) -> Column:
    """n evenly spaced places from the middle 80 % of the pages."""
    start, end = F.greatest(F.lit(0), F.floor(total * 0.10).cast("int")), F.least(total.cast("int"), F.floor(total * 0.90).cast("int"))
    step = F.greatest(F.lit(1), F.floor((end - start) / n).cast("int"))
    spread = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + i * step), lambda p: p < end)
    few = F.when(total > 0, F.sequence(F.lit(0), F.least(F.lit(n), total.cast("int")) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(end <= start, few).otherwise(spread)


def page_ranges(total: Column, each: int) -> Column:
    """(first, end) of parts of `each` pages."""
    starts = F.when(total > 0, F.sequence(F.lit(0), total.cast("int") - 1, F.lit(each))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + each, total.cast("int")).alias("end")))


def readable_bookmark(title: Column) -> Column:
    """Two characters or more, 70 % of them printable, and a letter among them."""
    bare = F.regexp_replace(title, f"^[{WHITE}]+|[{WHITE}]+$", "")
    printable = F.length(F.regexp_replace(bare, r"[\p{C}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", ""))
    return F.coalesce((F.length(bare) >= 2) & (printable / F.length(bare) >= 0.7) & bare.rlike(r"\p{L}"), F.lit(False))


def image_kinds(images: DataFrame) -> DataFrame:
    """images: file_id, page, width, height, bytes, page_area. Kind of each: icon, full-page, tiny or meaningful."""
    kind = F.when((F.col("width") < 50) | (F.col("height") < 50), "icon").when(F.col("width") * F.col("height") > F.col("page_area") * 0.7, "full-page").when(F.col("bytes") / 1024 < 2, "tiny").otherwise("meaningful")
    return images.withColumn("kind", kind)


def image_density(images: DataFrame, pages: DataFrame) -> DataFrame:
    """By file: images, meaningful ones, pages with any, images a page, and whether 70 % of its pages are one full-page image each. pages: file_id, total_pages."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    by_page = image_kinds(images).groupBy("file_id", "page").agg(F.count(F.lit(1)).alias("n"), n(F.col("kind") == "meaningful").alias("meaningful"), n(F.col("kind") == "full-page").alias("full"))
    d = by_page.groupBy("file_id").agg(F.sum("n").alias("total_images"), F.sum("meaningful").alias("meaningful"), F.count(F.lit(1)).alias("pages_with_images"), n((F.col("n") == 1) & (F.col("full") == 1)).alias("scan_pages"))
    d = pages.join(d, "file_id", "left").na.fill(0, ["total_images", "meaningful", "pages_with_images", "scan_pages"])
    return d.withColumn("images_per_page", F.when(F.col("total_pages") > 0, F.bround(F.col("total_images") / F.col("total_pages"), 2)).otherwise(0.0)).withColumn("likely_scan", F.col("scan_pages") >= F.col("total_pages") * 0.7)


def image_candidates(density: DataFrame, least: int = 1, scans: bool = False) -> DataFrame:
    """Files worth a look for their images, most first."""
    return density.where((F.col("meaningful") >= least) & (F.lit(scans) | ~F.col("likely_scan"))).orderBy(F.desc("meaningful"), "file_id")


def columned(blocks: DataFrame, least_blocks: int = 4) -> DataFrame:
    """Documents laid out in columns: on two sampled pages (or their only one) blocks begin on both sides with a gap of over 5 % between. blocks: doc_id, page, x0, x1, page_width."""
    left, right = F.col("x0") < 0.4 * F.col("page_width"), F.col("x0") > 0.3 * F.col("page_width")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    d = blocks.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), n(left).alias("n_left"), n(right).alias("n_right"), F.max(F.when(left, F.col("x1"))).alias("left_end"), F.min(F.when(right, F.col("x0"))).alias("right_start"), F.max("page_width").alias("width"))
    two = (F.col("n") >= least_blocks) & (F.col("n_left") >= 2) & (F.col("n_right") >= 2) & (F.col("right_start") - F.col("left_end") > 0.05 * F.col("width"))
    d = d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), n(two).alias("n_columned"))
    return d.withColumn("columned", F.col("n_columned") >= F.least(F.lit(2), F.col("n_pages")))


#: Parts of names of fonts whose characters may not be text.
RISKY_FONTS = ("symbol", "zapfdingbats", "cid", "identity-h", "identity-v", "wingdings", "dingbats")


def font_inventory(blocks: DataFrame, risky: tuple[str, ...] = RISKY_FONTS, most: int = 30) -> DataFrame:
    """Each document's fonts: how many, the first `most` by name, and all that are risky."""
    marked = lambda f: F.exists(F.array(*map(F.lit, risky)), lambda r: F.contains(F.lower(f), r))
    d = blocks.where(F.length("font_name") > 0).groupBy("doc_id").agg(F.sort_array(F.collect_set("font_name")).alias("all"))
    bad = F.filter("all", marked)
    return d.select("doc_id", F.size("all").alias("n_fonts"), F.slice("all", 1, most).alias("fonts"), bad.alias("risky_fonts"), (F.size(bad) > 0).alias("risky"))


def completeness(html: Column, total_pages: Column) -> Column:
    """Share in percent of the pages that left a marker; one page without any counts for a text that is not blank."""
    found = F.size(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)page[_-]?[0-9]+|PAGE:[0-9]+|class="page"'), F.lit(0))))
    pages = F.when(found > 0, found).when(F.regexp_replace(html, f"[{WHITE}]+", "") != "", 1).otherwise(0)
    return F.when(total_pages > 0, F.bround(pages / total_pages * 100, 1))


def notes_viability(text: Column) -> Column:
    """How well a back matter's numbered notes read: viable, degraded, unusable or none."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([0-9]{1,4})[.\s]\s*(\S.{10,})"), F.lit(2))

    def readable(note: Column) -> Column:
        words = F.slice(F.filter(F.split(note, r"\s+"), lambda w: w != ""), 1, 8)
        return F.size(F.filter(words, lambda w: w.rlike(r"^[\x00-\x7f]{2,20}$"))) / F.size(words) >= 0.6

    share = F.size(F.filter(F.slice(found, 1, 10), readable)) / F.least(F.lit(10), F.size(found))
    return F.when(F.size(found) < 3, "none").when(share >= NOTES[0], "viable").when(share >= NOTES[1], "degraded").otherwise("unusable")


def index_viability(text: Column) -> Column:
    """How much of an index reads as entries with page numbers."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    share = F.size(F.filter(F.slice(lines, 1, 20), lambda x: x.rlike(r"^.{3,},?\s+[0-9]{1,4}(?:\s*[-–,]\s*[0-9]{1,4})*\s*$"))) / F.least(F.lit(20), F.size(lines))
    return F.when(F.size(lines) < 5, "none").when(share >= INDEX[0], "viable").when(share >= INDEX[1], "degraded").otherwise("unusable")


def link_viability(links: Column, images: Column, large_images: Column) -> Column:
    """Struct of the verdicts on links and images from their counts."""
    return F.struct(F.when(links > 0, "viable").otherwise("none").alias("links"), F.when(images == 0, "none").when(large_images > 0, "viable").otherwise("decorative_only").alias("images"))


#: What a baseline of a page's HTML counts.
BASELINE = {"linked_footnotes": r'<sup><a\s+id="noteref_', "unlinked_footnotes": r"<sup>[0-9]+</sup>", "blockquotes": "<blockquote>", "em_tags": "<em>", "attributions": 'class="attribution"', "standalone_page_numbers": r"<p>[0-9]{1,3}</p>", "bold_tags": "<(?:strong|b)>"}


def baseline(html: Column) -> dict[str, Column]:
    """The measures of a converted page: headings (lists and counts), notes, marks, torn ligatures, doubled blanks, words, openings of chapters."""
    heads = {f"h{k}_headings": F.regexp_extract_all(html, F.lit(rf"<h{k}(?:\s[^>]*)?>(.+?)</h{k}>"), F.lit(1)) for k in (1, 2, 3)}
    text, bare = F.regexp_replace(html, "<[^>]+>", " "), F.regexp_replace(html, "<[^>]+>", "")
    out = {f"h{k}_count": F.size(heads[f"h{k}_headings"]) for k in (1, 2, 3)} | {n: F.regexp_count(html, F.lit(p)) for n, p in BASELINE.items()} | {"h1_headings": heads["h1_headings"], "h2_headings": heads["h2_headings"]}
    marks = penalties(F.regexp_replace(text, r"\s+", " "))
    sections = F.slice(F.split(html, r"<h2(?:\s[^>]*)?>.*?</h2>"), 2, 1 << 30)
    titles = F.regexp_extract_all(html, F.lit(r"<h2(?:\s[^>]*)?>(.*?)</h2>"), F.lit(1))
    said = lambda section: F.substring(F.regexp_replace(F.regexp_replace(F.regexp_extract(section, "<p>(.*?)</p>", 1), "<[^>]+>", ""), r"^\s+|\s+$", ""), 1, 60)

    def openings(t: Column, s: Column) -> Column:
        """Each heading with the first paragraph of its own section, or else of the nearest later one that has any."""
        marks = F.transform(F.reverse(s), lambda x, i: F.when(x.rlike("<p>.*?</p>"), i).otherwise(-1))
        nearest = lambda at: F.transform(s, lambda _, i: F.struct(F.get(t, i).alias("heading"), said(F.get(s, F.size(s) - 1 - F.get(at, F.size(s) - 1 - i))).alias("opening")))
        return F.filter(once(latest(marks), nearest), lambda o: o["opening"] != "")

    return out | {
        "ligature_splits": marks["n_ligatures"], "double_spaces": count_of(bare, "  "), "word_count": word_count(text), "encoding_errors": count_of(text, "�"), "chapter_count": out["h1_count"] + out["h2_count"],
        "has_front_matter_h1": F.exists(heads["h1_headings"], lambda h: F.contains(F.lower(h), F.lit("front matter"))), "chapter_openings": once(titles, lambda t: once(sections, lambda s: openings(t, s))),
    }


def column_merge(html: Column) -> Column:
    """Signs of columns read across: over 30 % long lines among the first 200 paragraphs of 20 characters or more, of which there are over 10."""
    plain = F.transform(F.slice(F.regexp_extract_all(html, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), 1, 200), lambda p: F.regexp_replace(F.regexp_replace(p, "<[^>]+>", ""), r"^\s+|\s+$", ""))
    seen = F.filter(plain, lambda p: F.length(p) >= 20)
    long = F.aggregate(seen, F.lit(0), lambda a, p: a + F.size(F.filter(F.split(p, "\n"), lambda x: F.length(F.trim(x)) > 150)))
    return (F.size(seen) > 10) & (long / F.greatest(F.lit(1), F.size(seen)) > 0.3)


def structure(html: Column, multicolumn: Column, path: Column) -> dict[str, Column]:
    """All that a page tells: baseline(), whether its headings are back matter alone, how its quality varies over its text (null for a short one), and whether columns may have run together, which is asked only of
    a source in columns that was not read by columns."""
    out, body = baseline(html), F.regexp_replace(html, "<[^>]+>", " ")
    merged = F.coalesce(multicolumn, F.lit(False)) & (F.coalesce(path, F.lit("")) != "pymupdf_columns") & column_merge(html)
    return out | {"only_backmatter": backmatter_only(F.concat(out["h1_headings"], out["h2_headings"])), "quality_variance": quality_variance(body), "possible_column_merge": merged}


def against_baseline(now: DataFrame, then: DataFrame, key: str) -> DataFrame:
    """A row for each rule and page: rule, expected, actual, passed. Both frames hold the measures of baseline().

    Measures beyond the first six are held against each other where both frames have them: the entries of the table of contents (all headings), lists of second-level headings (as numbers, how many are missing), and the
    output's size in KB, which may lie OUTPUT_TOLERANCE per cent off.
    """
    old = then.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in then.columns if c != key))
    d = now.join(old, key)
    row = lambda rule, c, ok: F.struct(F.lit(rule).alias("rule"), F.col(f"_{c}").cast("long").alias("expected"), F.col(c).cast("long").alias("actual"), ok.alias("passed"))
    within = [row(c, c, F.abs(F.col(c) - F.col(f"_{c}")) <= HEADING_TOLERANCE) for c in ("h1_count", "h2_count", "h3_count")]
    notes = F.when(F.col("_linked_footnotes") > 0, row("linked_footnotes", "linked_footnotes", F.col("linked_footnotes") >= F.col("_linked_footnotes")))
    most = [row(c, c, F.col(c) <= F.col(f"_{c}")) for c in ("ligature_splits", "double_spaces")]
    rules, both = [*within, notes, *most], set(now.columns) & set(then.columns)
    if {"h2_headings", "toc_entries"} <= both:
        rules.append(row("toc_entries", "toc_entries", F.abs(F.col("toc_entries") - F.col("_toc_entries")) <= TOC_TOLERANCE))
        lost = F.size(F.array_except("_h2_headings", "h2_headings")).cast("long")
        same = F.struct(F.lit("h2_headings").alias("rule"), F.lit(0).cast("long").alias("expected"), lost.alias("actual"), (F.col("h2_headings") == F.col("_h2_headings")).alias("passed"))
        rules.append(F.when((F.size("h2_headings") > 0) & (F.size("_h2_headings") > 0), same))
    if "output_kb" in both:
        rules.append(F.when(F.col("_output_kb") > 0, row("output_kb", "output_kb", F.abs(F.col("output_kb") - F.col("_output_kb")) * 100 <= OUTPUT_TOLERANCE * F.col("_output_kb"))))
    return d.select(key, F.explode(F.array_compact(F.array(*rules))).alias("r")).select(key, "r.*")


def heading_changes(now: DataFrame, then: DataFrame, key: str) -> DataFrame:
    """Second-level headings that went missing or came in; only where both have any and they differ."""
    d = now.select(key, "h2_headings").join(then.select(key, F.col("h2_headings").alias("_old")), key).where((F.size("h2_headings") > 0) & (F.size("_old") > 0) & (F.col("h2_headings") != F.col("_old")))
    return d.select(key, F.sort_array(F.array_except("_old", "h2_headings")).alias("missing"), F.sort_array(F.array_except("h2_headings", "_old")).alias("added"))


def openings_matched(now: DataFrame, then: DataFrame, key: str) -> DataFrame:
    """Of the headings that both have an opening for, how many openings begin alike (40 characters). Of equal headings the last counts."""

    def each(d: DataFrame, name: str) -> DataFrame:
        rows = d.select(key, F.posexplode("chapter_openings").alias("at", "o"))
        return rows.groupBy(key, F.col("o.heading").alias("heading")).agg(F.max(F.struct("at", F.substring("o.opening", 1, 40).alias("text"))).alias("x")).select(key, "heading", F.col("x.text").alias(name))

    same = F.when(F.col("new") == F.col("old"), 1).otherwise(0)
    return each(now, "new").join(each(then, "old"), [key, "heading"]).groupBy(key).agg(F.sum(same).alias("matched"), F.count(F.lit(1)).alias("compared"))


def sections(lines: DataFrame, heading: Column, *keys: str) -> DataFrame:
    """Each line with the heading that it stands under, null before the first. lines: keys, place."""
    w = W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(heading, F.col("line")), ignorenulls=True).over(w))


def chapters(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """Chapters that begin at paragraphs in capitals (120 characters at most, with a word of letters): title, and how many paragraphs and characters their bodies have. Chapters without a body are left out."""
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    heading = (bare != "") & (F.length(bare) <= 120) & (bare == F.upper(bare)) & bare.rlike(r"(?:^|\s)\p{L}{2,}(?:\s|$)")
    w = W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    d = paragraphs.withColumns({"bare": bare, "head": heading}).where("bare <> ''").withColumn("chapter", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(w))
    title = F.coalesce(F.max(F.when(F.col("head"), F.col("bare"))), F.lit("FRONT MATTER"))
    body = ~F.col("head")
    d = d.groupBy(*keys, "chapter").agg(title.alias("title"), F.sum(F.when(body, 1).otherwise(0)).alias("n_paragraphs"), F.sum(F.when(body, F.length("bare")).otherwise(0)).alias("n_chars"))
    return d.where("n_paragraphs > 0")


def best_extractors(comparisons: DataFrame) -> DataFrame:
    """comparisons: a map extractor -> struct(score, words). Wins of each extractor by score, ties to the first named; share in percent."""
    entries = F.map_entries("results")
    best = F.array_max(F.transform(entries, lambda e, i: F.struct(F.coalesce(e["value"]["score"], F.lit(0)).alias("score"), (-i).alias("first"), e["key"].alias("name"))))
    wins = comparisons.where(F.size("results") > 0).groupBy(best["name"].alias("extractor")).agg(F.count(F.lit(1)).alias("wins"))
    total = wins.agg(F.sum("wins").alias("total"))
    return wins.crossJoin(F.broadcast(total)).select("extractor", "wins", F.bround(F.col("wins") * 100 / F.col("total"), 1).alias("percent"))  # one row for each extractor, beside one row
