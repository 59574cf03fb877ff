"""Headings of a book's navigation against the paragraphs of its text: an alignment that keeps the order of both.

Titles and paragraphs are words in lower case. A heading meets a paragraph that is its title, or a short paragraph that holds the title's words; what meets comes from a join by the words, so no
heading is held against every paragraph. All headings of a title meet all its paragraphs. Of these pairs the heaviest chain that runs forward on both sides is taken, document by document; a heading
that is left over takes the first free paragraph that is its title. A paragraph serves one heading.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the longest paragraph that a title may lie within; the shortest title.
SHORT, LEAST = 15, 2
#: With more than BAND + 1 pairs for each heading, a document's pairs are not listed; parts of the way that such a document's chain is found again from. The chain is the same.
BAND, FAN = 8, 32
EXACT, WITHIN = 1000, 400  # weight of a pair; within a paragraph the share of its words that the title has counts too
MATCHES = "doc_id long, place int, paragraph int, exact boolean"
TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs(headings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, n, places, met: a row for each title of a document that some paragraph holds, not one for each pair, since all places meet all of met. n: the title's words; met: paragraph and size,
    its words. headings: doc_id, place, title; paragraphs: doc_id, place, text."""
    h = headings.select("doc_id", F.col("place").cast("int").alias("place"), words(F.col("title")).alias("w"))
    h = h.select("doc_id", "place", F.size("w").alias("n"), F.array_join("w", " ").alias("title")).where(F.length("title") >= LEAST)
    asked = h.groupBy("doc_id", "title").agg(F.max("n").alias("n"), F.collect_set("place").alias("places"))
    p = paragraphs.select("doc_id", F.col("place").cast("int").alias("paragraph"), words(F.col("text")).alias("w")).withColumn("size", F.size("w")).where("size > 0")
    # runs of other lengths than the document's titles have are no title, and without titles there is nothing to meet
    p = p.join(h.groupBy("doc_id").agg(F.collect_set("n").alias("lengths")), "doc_id")
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
    held = F.array_distinct(F.flatten(F.transform(F.filter("lengths", lambda k: k <= F.col("size")), runs)))
    p = p.select("doc_id", "paragraph", "size", F.explode(F.when(F.col("size") <= SHORT, held).when(F.array_contains("lengths", F.col("size")), F.array(F.array_join("w", " ")))).alias("title"))
    p = p.join(asked.select("doc_id", "title"), ["doc_id", "title"], "left_semi").groupBy("doc_id", "title").agg(F.collect_set(F.struct("paragraph", "size")).alias("met"))
    return asked.join(p, ["doc_id", "title"]).select("doc_id", "n", "places", "met")


def chain(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of (place, paragraph, weight) the heaviest chain whose places and paragraphs both rise; of equals the one whose last paragraph is the earliest. A tree of prefix maxima, so n log n."""
    spots = sorted({p for _, p, _ in rows})
    rank, none = {p: k + 1 for k, p in enumerate(spots)}, (0, 0, None)
    tree = [none] * (len(spots) + 1)  # (weight, last paragraph negated, chain as nested pairs)

    def best(k: int) -> tuple:
        out = none
        while k:
            out = max(out, tree[k], key=lambda x: x[:2])
            k &= k - 1
        return out

    for place, paragraph, weight in sorted(rows, key=lambda r: (r[0], -r[1])):
        k, before = rank[paragraph], best(rank[paragraph] - 1)
        new = (before[0] + weight, -paragraph, ((place, paragraph), before[2]))
        while k < len(tree):
            if new[:2] > tree[k][:2]:
                tree[k] = new
            k += k & -k
    out, at = [], best(len(spots))[2]
    while at:
        out.append(at[0])
        at = at[1]
    return out[::-1]


def long_chain(of: dict[int, tuple], offers: dict[tuple, dict[int, int]]) -> list[tuple[int, int]]:
    """chain() of every place with each paragraph that its kind is offered (of: kind of each place; offers: weight of each paragraph by kind), without a list of the pairs.

    The weights of the best chains by their last paragraph go forward over the places. They are kept at the starts of FAN parts of the way, from which the parts are gone through again, in parts of
    theirs, for the chain's links: time is places times paragraphs, memory FAN times paragraphs for each level of parts."""
    places, spots = sorted(of), np.array(sorted({x for d in offers.values() for x in d}))
    sides = {k: (np.searchsorted(spots, sorted(d)) + 1, np.array([d[x] for x in sorted(d)])) for k, d in offers.items()}
    start = lambda: (np.zeros(len(spots) + 1, np.int64), np.full(len(spots) + 1, -1, np.int32))  # noqa: E731  (weight of the best chain, its last place's number; spot 0 is before all)
    links = []

    def forward(a: int, b: int, best: np.ndarray, last: np.ndarray) -> None:
        for k in range(a, b):
            at, weight = sides[of[places[k]]]
            new = np.maximum.accumulate(best[: at[-1]])[at - 1] + weight
            rise = new > best[at]
            best[at[rise]], last[at[rise]] = new[rise], k

    def back(a: int, b: int, best: np.ndarray, last: np.ndarray, k: int, spot: int) -> tuple[int, int]:
        """Adds the links at places a to b, last first, from that at place k and spot; returns the one before them. best, last: as they are before place a."""
        if b - a == 1:
            links.append((places[k], int(spots[spot - 1])))
            spot = int(best[:spot].argmax())
            return int(last[spot]), spot
        step, kept = -(-(b - a) // FAN), []
        for at in range(a, k + 1, step):
            if kept:
                forward(at - step, at, best, last)
            kept.append((at, best.copy(), last.copy()))
        while kept:
            at, best, last = kept.pop()
            if k >= at:
                k, spot = back(at, min(at + step, b), best, last, k, spot)
        return k, spot

    best, last = start()
    forward(0, len(places), best, last)
    spot = int(best.argmax())
    back(0, len(places), *start(), int(last[spot]), spot)
    return links[::-1]


def _matched(doc: int, titles: list[dict]) -> Iterator[tuple]:
    of, offers = {}, {}  # a place has one title, unless its document comes twice
    for k, t in enumerate(titles):
        for place in t["places"]:
            of[place] = (*of.get(place, ()), k)
    for kind in set(of.values()):
        mine = offers[kind] = {}
        for n, x in ((titles[k]["n"], x) for k in kind for x in titles[k]["met"]):
            mine[x["paragraph"]] = max(mine.get(x["paragraph"], 0), EXACT if n == x["size"] else int(WITHIN + 100 * n / x["size"]))
    listed = sum(len(offers[kind]) for kind in of.values()) <= (BAND + 1) * len(of)
    taken = dict(chain([(place, p, weight) for place, kind in of.items() for p, weight in offers[kind].items()]) if listed else long_chain(of, offers))
    used, free = set(taken.values()), {kind: deque(sorted(p for p, weight in d.items() if weight == EXACT)) for kind, d in offers.items()}
    for place in sorted(of.keys() - taken.keys()):
        left = free[of[place]]
        while left and left[0] in used:
            left.popleft()
        if left:
            taken[place] = left[0]
            used.add(left[0])
    return ((doc, a, b, offers[of[a]][b] == EXACT) for a, b in sorted(taken.items()))


def matched(headings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """MATCHES: a row for each heading that has a paragraph. What meets in a row is one document's headings and the paragraphs that hold their titles, each once for a title."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MATCHES.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                rows = [r for d in b.slice(at, 1000).to_pylist() for r in _matched(d["doc_id"], d["titles"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), TYPES, strict=True)], names)

    titles = F.collect_list(F.struct("n", "places", "met")).alias("titles")
    return pairs(headings, paragraphs).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(titles).mapInArrow(each, MATCHES)


def roles(headings: DataFrame, matches: DataFrame) -> DataFrame:
    """matches with role: headings of the first level are parts and others chapters; where all are of the first level, all are chapters."""
    deep = headings.groupBy("doc_id").agg(F.max("level").alias("deepest"))
    d = matches.join(headings.select("doc_id", F.col("place").cast("int").alias("place"), "level"), ["doc_id", "place"]).join(deep, "doc_id")
    return d.select("doc_id", "place", "paragraph", "exact", F.when((F.col("level") == 1) & (F.col("deepest") > 1), "part").otherwise("chapter").alias("role"))
