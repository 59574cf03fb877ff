"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits: bit k is 1 if it is set in over half of the XXH64 values (seed 42) of a
text's word shingles. Two fingerprints at distance TAU or less agree, in one of m parts of the bits,
to within that part's threshold, whatever thresholds sum to TAU - m + 1 (-1 leaves a part out). The
parts gather correlated bits; m and the thresholds come from dynamic programming on candidate
counts, estimated from the bits' agreement over all distinct fingerprints. Each fingerprint is
filed under its parts' values (and, where a part allows one differing bit, the values one flip
away); fingerprints filed together are verified. A bucket of more than CAP fingerprints is not
paired: its members are filed under all 64-bit values within one flip, and those that share such a
value are within two bits of each other, so a star through their least links exactly them.

Null text has no words: fingerprint zero. Null doc_ids are nobody's least id (a component of only
such rows has a null id). Repeated rows share a fingerprint. A very long text costs a task the memory of its words. Other columns are ignored. An
empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_in, stored
from .components import connected_components

TAU = 2
CAP = 64
LISTED = 200_000  # hot buckets that may be broadcast (8 bytes each)
SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """Of words with A-Z lowered; a text of fewer words is one shingle, one of none gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    of = xxhash.xxh64_intdigest
    hashes = [of(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for k in range(0, len(values), 4096):
        bits = np.unpackbits(values[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            fp = np.fromiter((fingerprint(t, width) for t in p["text"]), np.uint64, len(p)).view(np.int64)
            yield pd.DataFrame({"doc_id": p["doc_id"], "fp": fp})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(each, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """The 64 x 64 numbers of fingerprints that have both bits, and how many there are; 4096 sums reach the driver, at any size."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64))
        n = 0
        for p in parts:
            bits = np.unpackbits(p["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(p)
        yield pd.DataFrame({"k": np.arange(4097), "c": np.append(total.ravel(), n).astype(np.int64)})

    got = fps.select("fp").mapInPandas(each, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(4097)
    for r in got:
        flat[r["k"]] = r["c"]
    return flat[:4096].reshape(64, 64), int(flat[4096])


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m parts of about 64 / m bits: each starts at the free bit with the strongest tie and takes the bits most correlated with it so far."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    free, parts = set(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        left = sorted(free)
        first = left[int(np.argmax(r[np.ix_(left, left)].max(axis=1)))]
        part = [first]
        free.discard(first)
        while len(part) < size:
            left = sorted(free)
            best = left[int(np.argmax(r[np.ix_(left, part)].sum(axis=1)))]
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def allocate(parts: list[list[int]], agree: np.ndarray, n: int, tau: int = TAU) -> tuple[float, list[int]]:
    """Least estimated cost and the thresholds that have it, by dynamic programming over parts and the sum so far.

    Cost of a part: its filed rows, and a fifth of its expected pairs (Poisson-binomial over the bits' agreement).
    """
    cost = []
    for part in parts:
        same = np.array([1.0])  # distribution of the number of differing bits
        for b in part:
            same = np.convolve(same, [agree[b], 1 - agree[b]])
        within = np.cumsum(same)
        cost.append({-1: 0.0, 0: n + 0.1 * n * n * within[0], 1: n * (len(part) + 1) + 0.1 * n * n * within[min(2, len(part))]})
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, x in c.items():
                if total + t not in after or spent + x < after[total + t][0]:
                    after[total + t] = (spent + x, [*chosen, t])
        best = after
    return best[tau - len(parts) + 1]


def plan(both: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe, for the number of parts that costs least."""
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 1e-6, 1 - 1e-6)
    options = [(allocate(parts, agree, n, tau), parts) for parts in (correlated_parts(both, n, m) for m in (2, 3, 4))]
    (_, thresholds), parts = min(options, key=lambda x: x[0][0])
    return [(part, t) for part, t in zip(parts, thresholds, strict=True) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _filed(fps: DataFrame, probes: list[tuple[list[int], int]]) -> DataFrame:
    """key, fp: a row for each part's value, and for each flip where a part allows one."""
    keys: list[Column] = []
    for k, (bits, t) in enumerate(probes):
        masked = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
        keys += [F.xxhash64(F.lit(k), masked)] + [F.xxhash64(F.lit(k), masked.bitwiseXOR(F.lit(_signed(1 << b)))) for b in bits if t == 1]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def near_pairs(fps: DataFrame, tau: int = TAU, cap: int = CAP) -> DataFrame:
    """a, b: edges between distinct fingerprints that connect just those within tau = 2 bits."""
    both, n = bit_counts(fps)
    filed = _filed(fps, plan(both, n, tau))
    hot = stored(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select("key"))
    listed = F.broadcast(hot) if hot.count() <= LISTED else hot
    few = filed.join(listed, "key", "left_anti").groupBy("key").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
    near = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= tau)), lambda y: F.struct(y.alias("a"), x.alias("b")))))
    verified = few.select(F.explode(near).alias("p")).select("p.a", "p.b")
    many = filed.join(listed, "key", "left_semi").select("fp").distinct()
    middle = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)))
    middles = many.select("fp", F.explode(middle).alias("mid"))
    least = middles.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "b")
    star = middles.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return verified.unionByName(star).distinct()


def near_components(docs: DataFrame, width: int = 3, tau: int = TAU) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    every = stored(fingerprints(docs, width))
    fps = stored(every.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(near_pairs(fps, tau)).withColumnRenamed("node", "fp")
    of = fps.join(roots, "fp")
    lows = of.groupBy("root").agg(F.min("low").alias("component_id"))
    met = of.join(lows, "root").select("fp", "component_id")
    classes = fps.join(met, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return every.join(stored(classes), "fp")
