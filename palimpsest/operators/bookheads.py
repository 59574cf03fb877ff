"""Headings of e-book pages in four layers of evidence, and pages to look at."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .layout import CHAPTERS

#: Confidence of each layer in hundredths; lengths; the size, in points, from which styled text is a heading.
SEMANTIC, CLASSED, STYLED, STRUCTURAL = 95, 85, 75, 70
SHORTEST, LONGEST, LARGE_POINTS, STYLED_WORDS = 3, 120, 16, 15
NAMED = "(?i)chapter|heading|title|part|section"
SIZE, BOLD = r"(?i)font-size\s*:\s*([0-9.]+)\s*(px|pt|em|rem)", r"(?i)font-weight\s*:\s*(bold|[7-9][0-9][0-9])"


def _plain(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), r"\s+", " "))


def epub_headings(pages: DataFrame, html: str, key: str, layers: tuple[int, ...] = (1, 2, 3, 4), shortest: int = SHORTEST) -> DataFrame:
    """A row for each heading text of a page, from the strongest of the layers that has it: h1 to h3; a class that names one; large or bold style; a chapter's name. Elements without others of their own name inside."""

    def found(pattern: str, layer: int) -> Column:
        return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda x, i: F.struct(F.lit(layer).alias("layer"), i.alias("i"), x.alias("x")))

    element = r"(?is)<(\w+)\b[^>]*\b{}\s*=\s*[\"'][^\"']*[\"'][^>]*>(?:(?!</?\1\b).)*</\1>"
    patterns = {1: r"(?is)<(h[1-3])\b[^>]*>(?:(?!</\1).)*</\1>", 2: element.format("class"), 3: element.format("style"), 4: r"(?is)<(div|p)\b[^>]*>(?:(?!</?\1\b).)*</\1>"}
    every = F.concat(*(found(patterns[layer], layer) for layer in layers))
    d = pages.select(key, F.explode(every).alias("e")).select(key, "e.layer", "e.i", _plain(F.col("e.x")).alias("text"), F.regexp_extract("e.x", r"(?s)^<([^>]*)>", 1).alias("tag"))
    of = lambda name: F.regexp_extract("tag", rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)", 1)
    style, unit = of("style"), F.lower(F.regexp_extract(of("style"), SIZE, 2))
    points = F.regexp_extract(style, SIZE, 1).try_cast("double") * F.when(unit == "px", 0.75).when(unit.isin("em", "rem"), 12.0).otherwise(1.0)
    words = F.size(F.split("text", " "))
    fits = F.when(F.col("layer") == 1, True).when(F.col("layer") == 2, of("class").rlike(NAMED)).when(F.col("layer") == 3, (F.coalesce(points >= LARGE_POINTS, F.lit(False)) | style.rlike(BOLD)) & (words <= STYLED_WORDS)).otherwise(F.col("text").rlike(CHAPTERS))
    name = F.lower(of("class"))
    level = F.when(F.col("layer") == 1, F.substring("tag", 2, 1).cast("int")).when(F.col("layer") == 2, F.when(name.rlike("part|chapter|title"), 1).otherwise(2)).when(F.col("layer") == 3, 2).otherwise(1)
    d = d.withColumns({"level": level, "confidence": F.when(F.col("layer") == 1, SEMANTIC).when(F.col("layer") == 2, CLASSED).when(F.col("layer") == 3, STYLED).otherwise(STRUCTURAL)})
    d = d.where(F.length("text").between(shortest, LONGEST) & fits)
    first = W.partitionBy(key, F.lower("text")).orderBy("layer", "level", "i")
    return d.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, "text", "layer", "level", "confidence")


def sampled_pages(total: int, most: int = 8, marks: list[int] | None = None) -> list[int]:
    """Pages of a book to look at: the first three, some of its chapter starts, more from the back than from the body; the widest gaps are halved until there are enough."""
    if total <= most:
        return list(range(1, total + 1))
    chosen = set(range(1, min(3, total) + 1))
    starts = sorted(set(marks or []))
    if most > 10:
        chosen.update(p for p in starts if 1 <= p <= total)
    elif len(starts) <= 2:
        chosen.update(starts)
    else:
        third = len(starts) // 3
        chosen.update((starts[third], starts[-third] if third else starts[-1]))
    left = most - len(chosen)
    if left > 0:
        back, middle = int(total * 0.75), int(total * 0.15)
        n_back = max(1, left * 2 // 5)
        for low, high, n in ((middle, back, left - n_back), (back, total, n_back)):
            if n > 0 and high > low:
                chosen.update(p for k in range(1, n + 1) if 1 <= (p := int(low + (high - low) / (n + 1) * k)) <= total)
    while len(chosen) < min(most, total):
        order = sorted(chosen)
        gap, low = max(((b - a, -a) for a, b in zip(order, order[1:])), default=(0, 0))
        if gap <= 1:
            break
        chosen.add(-low + gap // 2)
    return sorted(chosen)[:most]


def with_samples(books: DataFrame, total: str, marks: str, most: int = 8) -> DataFrame:
    """books with sampled, the pages to look at; total pages and an array of chapter starts are columns."""
    columns = [c for c in books.columns if c != "sampled"]

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[columns].assign(sampled=[sampled_pages(int(t or 0), most, None if m is None else [int(x) for x in m]) for t, m in zip(p[total], p[marks], strict=True)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in books.schema if f.name != "sampled")
    return books.select(*columns).mapInPandas(each, f"{fields}, sampled array<int>")


def scene_break(paragraph: Column) -> Column:
    """A paragraph of one to ten marks and blanks without a letter or digit parts two scenes."""
    bare = F.trim(paragraph)
    return F.coalesce((F.length(bare) > 0) & (F.length(bare) <= 10) & ~bare.rlike(r"[\p{L}\p{N}]") & bare.rlike("[*#~⁂—–_=-]"), F.lit(False))


def joined_letters(text: Column, words: tuple[str, ...]) -> Column:
    """Runs of four or more single letters with blanks between, at least three of them different, become a word of the list, if they spell one."""
    known = F.array(*(F.lit(w.lower()) for w in words))
    run = r"(?<![\p{L}\p{N}])\p{L}(?: \p{L}){3,}(?![\p{L}\p{N}])"
    found, between = F.regexp_extract_all(text, F.lit(run), F.lit(0)), F.split(text, run, -1)

    def whole(r: Column) -> Column:
        word = F.replace(r, F.lit(" "), F.lit(""))
        return F.when((F.size(F.array_distinct(F.split(F.lower(word), ""))) >= 3) & F.array_contains(known, F.lower(word)), word).otherwise(r)

    return F.array_join(F.zip_with(between, found, lambda b, r: F.concat(b, F.coalesce(whole(r), F.lit("")))), "")
