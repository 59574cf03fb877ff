"""Packing into windows of WINDOW tokens by non-negative least squares over length combinations.

A document of n tokens gives full windows and one rest, so lengths are 1..WINDOW and their
histogram has at most WINDOW numbers, whatever the input's size. Shallow combinations (one, two or three
lengths) that fill a window exactly are columns; repeat counts that solve the histogram in least
squares, none negative, are rounded down and clipped to what is there; the rest is packed greedily:
the longest rest first, the longest that still fits next, and where nothing fits a rest is cut.

Pieces of a length are numbered by the part they lie in (counted once, offsets by a window over the
parts' counts), so no length, however common, meets in one task. Only histogram and plan, both bounded by
WINDOW, pass the driver.

ids_crc32 is of a piece's ids as 32-bit little-endian integers. Null text counts as empty (one token, the end). Repeated rows are
packed each; which of equally long pieces goes where follows from their order in the parts. A very long text makes as many full windows as it needs.
Other columns are ignored. An empty table gives an empty result.
"""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder, lots, with_end

WINDOW = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"
SHALLOW = 128  # lengths that triples are made of
LISTED = 4_000_000  # counts by part and length that may be broadcast, some 20 bytes each; more are joined by a shuffle
PIECES = "doc_id long, start long, length int, doc_tokens long, part int, place long, ids binary"
PLACED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, ids_crc32 long"


def cut_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """PIECES: full windows and rests; place counts the pieces of the same length in the part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), encoder(TOKENIZER, "word")
        for b in lots(batches):
            ids, n = with_end(*enc.encode(b["text"]), END)
            pieces = -(-n // window)
            of = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(n[of] - start, window)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            place = np.empty(len(of), np.int64)
            place[order] = np.arange(len(of)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(length, minlength=window + 1)
            columns = [b["doc_id"].take(pa.array(of)), start, length.astype(np.int32), n[of], np.full(len(of), part, np.int32), place, binaries(ids, length)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "start", "length", "doc_tokens", "part", "place", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, PIECES)


def binaries(ids: np.ndarray, length: np.ndarray) -> pa.Array:
    """A binary value for each run of `length` 16-bit ids."""
    offsets = np.concatenate(([0], np.cumsum(length) * 2)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u2"))])


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Columns of up to three lengths that fill a window: every pair, and triples of the SHALLOW most common lengths with what completes them."""
    there = np.flatnonzero(hist)
    rows = [(window, 0, 0)] if hist[window] else []
    rows += [(a, window - a, 0) for a in there if a < window and a >= window - a and hist[window - a]]
    common = there[np.argsort(-hist[there], kind="stable")][:SHALLOW]
    a, b = (x.ravel() for x in np.meshgrid(common, common))
    c = window - a - b
    fit = (a >= b) & (c > 0)
    fit[fit] = hist[c[fit]] > 0
    rows += list({tuple(sorted(x, reverse=True)) for x in zip(a[fit].tolist(), b[fit].tolist(), c[fit].tolist(), strict=True)})
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def non_negative_least_squares(columns: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that nearly minimises |A x - hist|, by multiplicative updates; column j of A counts the lengths in columns[j]."""
    n = len(hist)
    x = np.ones(len(columns))
    weight = (columns > 0).astype(float)
    up = (hist[columns] * weight).sum(axis=1)
    for _ in range(rounds):
        made = np.bincount(columns.ravel(), (x[:, None] * weight).ravel(), minlength=n)
        x *= up / np.maximum((made[columns] * weight).sum(axis=1), 1e-12)
    return x


def make_plan(hist: np.ndarray, window: int = WINDOW) -> pd.DataFrame:
    """Runs of equal windows: length, first, last (places of that length, last exclusive), sequence (of the first), offset, take.

    take < length: only so many tokens go there and the rest is a piece of length - take whose places
    begin at next.
    """
    left = hist.astype(np.int64).copy()
    used = np.zeros(len(hist), np.int64)  # places of each length given out
    total = left.copy()  # places there are, those that cuts add included
    runs: list[tuple] = []
    sequence = 0

    def give(length: int, n: int, offset: int, take: int) -> None:
        nonlocal runs
        after = -1
        if take < length:
            after = int(total[length - take])
            total[length - take] += n
            left[length - take] += n
        runs.append((length, int(used[length]), int(used[length]) + n, sequence, offset, take, after))
        used[length] += n
        left[length] -= n

    columns = combinations(hist, window)
    if len(columns):
        repeats = np.floor(non_negative_least_squares(columns, hist.astype(float)) + 1e-9).astype(np.int64)
        for col, n in zip(columns.tolist(), repeats.tolist(), strict=True):
            parts = [c for c in col if c]
            n = min([n, *(int(left[c]) // parts.count(c) for c in set(parts))])
            if n > 0:
                offset = 0
                for c in parts:
                    give(c, n, offset, c)
                    offset += c
                sequence += n
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        parts, gap, count = [(first, first)], window - first, defaultdict(int, {first: 1})
        while gap:
            fits = [c for c in np.flatnonzero(left[: gap + 1])[::-1] if left[c] > count.get(int(c), 0)]
            if fits:
                c = int(fits[0])
                parts.append((c, c))
                count[c] += 1
                gap -= c
                continue
            rest = [c for c in np.flatnonzero(left)[::-1] if left[c] > count.get(int(c), 0)]
            if rest:
                c = int(rest[0])
                parts.append((c, gap))
                count[c] += 1
                gap = 0
            else:
                break
        n = max(1, min(int(left[c]) // k for c, k in count.items()))
        offset = 0
        for c, take in parts:
            give(c, n, offset, take)
            offset += take
        sequence += n
    return pd.DataFrame(runs, columns=["length", "first", "last", "sequence", "offset", "take", "next"])


def place_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """PLACED rows for a stored table of PIECES."""
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts)
    hist = np.zeros(window + 1, np.int64)
    listed = 0
    for r in counts.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect():  # at most WINDOW rows
        hist[r["length"]] = r["n"]
        listed += r["rows"]
    plan = make_plan(hist, window).sort_values(["length", "first"], kind="stable")
    key = plan["length"].to_numpy(np.int64) << 44 | plan["first"].to_numpy(np.int64)
    runs = {c: plan[c].to_numpy(np.int64) for c in ("first", "sequence", "offset", "take", "next")}
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begin = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    begin = F.broadcast(begin) if listed <= LISTED else begin.hint("merge")
    numbered = pieces.join(begin, ["part", "length"]).withColumn("place", F.col("place") + F.col("begin")).drop("begin", "part")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            start, length, place = (b[c].to_numpy().astype(np.int64) for c in ("start", "length", "place"))
            row, at = np.arange(len(length)), np.zeros(len(length), np.int64)
            found = []  # row, at (ids before, in the piece), take, sequence, offset; a cut piece goes round again
            while len(row):
                k = np.searchsorted(key, length << 44 | place, "right") - 1
                take, on = runs["take"][k], place - runs["first"][k]
                found.append((row, at, take, runs["sequence"][k] + on, runs["offset"][k]))
                cut = take < length
                row, at, length, place = row[cut], (at + take)[cut], (length - take)[cut], (runs["next"][k] + on)[cut]
            row, at, take, sequence, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            ids = [x[2 * a : 2 * (a + n)] for x, a, n in zip(b["ids"].take(pa.array(row)).to_pylist(), at.tolist(), take.tolist(), strict=True)]
            crc = np.fromiter((zlib.crc32(np.frombuffer(x, "<u2").astype("<u4")) for x in ids), np.int64, len(ids))
            columns = [b["doc_id"].take(pa.array(row)), start[row] + at, take, b["doc_tokens"].take(pa.array(row)), sequence, offset, pa.array(ids, pa.binary()), crc]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "ids_crc32"])

    return numbered.select("doc_id", "start", "length", "doc_tokens", "place", "ids").mapInArrow(each, PLACED)


def pack(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return place_pieces(stored(cut_documents(docs, window), "lz4"), window)
