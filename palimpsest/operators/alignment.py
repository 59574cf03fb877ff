"""Chapters of a source against the headings of its conversion: a greedy match by likeness of titles, then of what follows.

Bookmarks choose in their order, each the free heading most like it. Most choose a title that is the same letter for letter, found by a table; for the others the letters that two titles share bound their
likeness from above, so headings are looked at by that bound, the highest first, and no more of them once the best found is above the next bound. The rows are those of holding each against each.
A document's bookmarks and headings are its own, so a group is small whatever the number of documents.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_heading

LEAST_TITLE, TITLE_ONLY, ALIGNED = 0.5, 0.7, 0.6
TITLE_WEIGHT, BODY_WEIGHT, COMPARED, SNIPPET = 0.4, 0.6, 150, 200
MATCHES = "doc_id long, place int, heading int, title_score double, body_score double, combined double, status string"
TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())


def _alike(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


class Free:
    """Headings that no bookmark has taken: by text, and as counts of their letters."""

    def __init__(self, titles: list[str]):
        self.titles, self.free = titles, np.ones(len(titles), bool)
        self.same: dict[str, list[int]] = {}
        for k in range(len(titles) - 1, -1, -1):
            self.same.setdefault(titles[k], []).append(k)  # the first comes last
        letters = sorted({c for t in titles for c in t})
        self.letter = {c: k for k, c in enumerate(letters)}
        self.counts = np.zeros((len(titles), len(letters)), np.int32)
        for k, t in enumerate(titles):
            for c, n in Counter(t).items():
                self.counts[k, self.letter[c]] = n
        self.size = np.array([len(t) for t in titles], np.int64)

    def bounds(self, title: str) -> np.ndarray:
        """No ratio of title with a heading is higher: twice the letters they share over all letters."""
        known = {self.letter[c]: n for c, n in Counter(title).items() if c in self.letter}
        shared = np.minimum(self.counts[:, list(known)], np.array(list(known.values()), np.int32)).sum(axis=1) if known else np.zeros(len(self.titles))
        return np.where(self.free, 2.0 * shared / np.maximum(self.size + len(title), 1), -1.0)

    def take(self, title: str) -> tuple[int | None, float]:
        """The free heading most like title, the first of equals, if it is like enough."""
        same = self.same.get(title, [])
        if same:
            k = same.pop()
            self.free[k] = False
            return k, 1.0
        bound = self.bounds(title)
        best, score = None, 0.0
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < max(score, LEAST_TITLE):
                break
            s = _alike(title, self.titles[k])
            if s > score or s == score and best is not None and k < best:
                best, score = k, s
        if best is None or score < LEAST_TITLE:
            return None, 0.0
        self.free[best] = False
        self.same[self.titles[best]].remove(best)
        return best, score


def _align(doc: int, marks: list[dict], heads: list[dict]) -> Iterator[tuple]:
    free = Free([h["title"] for h in heads])
    for m in marks:
        k, title = free.take(m["title"])
        if k is None:
            yield doc, m["place"], None, 0.0, 0.0, 0.0, "unmatched"
            continue
        h = heads[k]
        body = _alike(m["body"][:COMPARED], h["body"][:COMPARED]) if m["body"] and h["body"] else 0.0
        both = TITLE_WEIGHT * title + BODY_WEIGHT * body
        yield doc, m["place"], h["place"], round(title, 3), round(body, 3), round(both, 3), "aligned" if both >= ALIGNED else "title_only" if title >= TITLE_ONLY else "misaligned"


def aligned(bookmarks: DataFrame, headings: DataFrame) -> DataFrame:
    """bookmarks and headings: doc_id, place, title, body. A row for each bookmark."""

    def listed(d: DataFrame, name: str) -> DataFrame:
        entry = F.struct(F.col("place").cast("int").alias("place"), normal_heading(F.col("title")).alias("title"), normal_heading(F.col("body")).alias("body"))
        return d.select("doc_id", entry.alias("e")).groupBy("doc_id").agg(F.sort_array(F.collect_list("e")).alias(name))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MATCHES.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = [r for d in b.slice(at, 1000).to_pylist() for r in _align(d["doc_id"], d["marks"], d["heads"] or [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), TYPES, strict=True)], names)

    heads = listed(headings, "heads").withColumnRenamed("doc_id", "_doc")
    return listed(bookmarks, "marks").join(heads, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc").mapInArrow(each, MATCHES)


def alignment_scores(matches: DataFrame) -> DataFrame:
    """By document: bookmarks by status, and the share aligned in whole percent."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    d = matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), n("aligned").alias("aligned"), n("title_only").alias("title_only"), n("misaligned").alias("misaligned"), n("unmatched").alias("unmatched"))
    return d.withColumn("score", F.bround(F.col("aligned") * 100 / F.greatest("total", F.lit(1))).cast("long"))


def output_headings(pages: DataFrame, html: str, key: str) -> DataFrame:
    """Headings of the first three levels with up to SNIPPET characters of the paragraphs that follow before the next."""
    found = F.regexp_extract_all(html, F.lit(r"<h[123]>.*?</h[123]>"), F.lit(0))
    after = F.slice(F.split(html, r"<h[123]>.*?</h[123]>"), 2, 1 << 30)
    d = pages.select(F.col(key).alias("doc_id"), F.posexplode(F.arrays_zip(found.alias("h"), after.alias("after"))).alias("place", "x"))
    bare = lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""))
    parts = F.filter(F.transform(F.regexp_extract_all("x.after", F.lit("<p>(.*?)</p>"), F.lit(1)), bare), lambda t: t != "")
    return d.select("doc_id", "place", bare(F.col("x.h")).alias("title"), F.substring(F.array_join(parts, " "), 1, SNIPPET).alias("body"))
