"""Near copies by Jaccard similarity of word-shingle sets: SimHash candidates by the generalised pigeonhole, verified exactly.

A text is its set of five-word shingles. Its fingerprint has BITS bits, bit k the majority of bit k of the set's
hashes, so the share of bits in which two sets differ follows from their similarity (turn below). Parts of
the most correlated bits hold one window each; a fingerprint is filed under a part's value and the values one flip away, so
two that differ there in two bits or fewer meet. How many bits a part has grows with the logarithm of the number of
texts, so chance meetings stay few; which parts are used, and with what threshold (left out, equal, or two bits), follows from
dynamic programming on candidate counts, estimated from the bits' agreement: the least that find a pair of just the
wanted similarity with probability FOUND, and closer pairs almost surely.

Those that meet in a bucket are tied to its leader, the one whose values most others share, as the original of a family of
copies has; a bucket that may be large is dealt to salted parts with leaders of their own first. So links are linear in what is
filed and no group is paired. A tie counts only if the exact similarity of both whole sets reaches the limit. Connected ties
make components.

What these ties leave out is found exactly: two sets of the similarity share a shingle among the first of each, in any one order of all
shingles, if as many are taken as a set may lack and one more; if each takes k more, they share k + 1. So the first shingles of every set and a tenth of it more are filed, frequent ones last in the
order; sets that meet too few of other components there have no partner. Of the others all shingles are counted and the rarest come first, those of one component alone before all; two of different
components that meet are held against each other, whole, unless too few shingles are left behind the place where they meet. What is in one component already is not paired.

Words are as in simhash (ASCII white space apart, A-Z lowered). A text of fewer words than a shingle is one
shingle, so equal ones are copies; texts without words equal each other. Equal sets are one node. Null doc_ids are nobody's least
id. Repeated rows are alike. A very long text costs a row of its set. Other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components
from .kneser_ney import MULTIPLY, _mix, hashed_tokens

WIDTH, SIMILARITY, FOUND = 5, 0.8, 0.9
WORDS = 8  # 64-bit words of a fingerprint
BITS = 64 * WORDS
LISTED = 200_000  # hot values that may be broadcast (8 bytes each)
AHEAD = 0.1  # share of a set's shingles that is filed beyond those it may lack: a set without a partner seldom meets so many, and what is filed grows by half
FREQUENT = 16  # sets whose first shingles hold one, beyond which it comes last in the order of shingles
CROWD, SALTS = 5_000, 64  # texts with one value of a part beyond which its buckets are dealt to salted parts
NODE = ", ".join(["id long", *(f"w{k} long" for k in range(WORDS))])
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of each text, one text after another and ascending in each, and how many each has."""
    tokens, n = hashed_tokens(texts)
    last = np.cumsum(n) - 1  # where each text's end mark is
    words = n - 1
    many = np.maximum(words - width, 0) + 1
    of = np.repeat(np.arange(len(n)), many)
    begin = np.repeat(last - words, many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    h = np.zeros(len(of), np.uint64)
    for k in range(width):
        at = begin + k
        h = _mix(h * MULTIPLY + np.where(at < last[of], tokens[np.minimum(at, last[of])], np.uint64(0)) + np.uint64(k))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(n))


def _ids(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each set's own hash."""
    if not len(n):
        return np.zeros(0, np.int64)
    total = np.add.reduceat(_mix(h), np.cumsum(n) - n)
    return _mix(total ^ n.astype(np.uint64)).view(np.int64)


def fingerprints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, WORDS): bit counts come from histograms of each byte of the hashes, so no bit of a hash is looked at alone."""
    out = np.zeros((len(n), WORDS), np.uint64)
    at = np.concatenate(([0], np.cumsum(n)))
    first = 0
    while first < len(n):
        last = max(first + 1, min(first + 256, int(np.searchsorted(at, at[first] + 100_000, "right")) - 1))
        some, rows = h[at[first] : at[last]], last - first
        of = np.repeat(np.arange(rows) * 256, n[first:last])
        for k in range(WORDS):
            seen = _mix(some + np.uint64(k * int(MULTIPLY) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
            bits = np.empty((rows, 64), bool)
            for b in range(8):
                counts = np.bincount(of + seen[:, b], minlength=rows * 256).reshape(rows, 256).astype(np.float32)
                bits[:, 8 * b : 8 * b + 8] = 2 * (counts @ _SIGNS) > n[first:last, None]
            out[first:last, k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
        first = last
    return out


def _described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, id (of the set), and the fingerprint's words."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            h, n = shingle_sets(p["text"].tolist(), width)
            words = fingerprints(h, n).view(np.int64)
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "id": _ids(h, n), **{f"w{k}": words[:, k] for k in range(WORDS)}})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(each, f"doc_id long, {NODE}")


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")


def _words_of(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b[f"w{k}"].to_numpy() for k in range(WORDS)], axis=1)


def bit_counts(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """How many fingerprints have both bits, for each pair of bits, and how many there are; BITS * BITS sums reach the driver, at any size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = _bits(_words_of(b)).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["k", "c"])

    few = nodes.coalesce(max(12, nodes.sparkSession.sparkContext.defaultParallelism)).mapInArrow(each, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    got = few.toArrow()
    flat = np.zeros(BITS * BITS + 1)
    flat[got["k"].to_numpy()] = got["c"].to_numpy()
    return flat[:-1].reshape(BITS, BITS), int(flat[-1])


def turn(similarity: float) -> float:
    """Expected share of differing bits of two sets of equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def part_width(n: int) -> int:
    """Bits of a part: chance meetings of two bits' reach come to about one in six for each fingerprint and part."""
    return min(40, max(16, math.ceil(math.log2(max(n, 2)) + 7.5)))


def correlated_parts(both: np.ndarray, n: int, width: int) -> list[list[int]]:
    """Parts of `width` bits: each starts at the free bit with the strongest tie and takes the bits most correlated with it so far."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    free, parts = np.ones(len(p), bool), []
    while free.sum() >= width:
        part = [int(np.argmax(np.where(free, np.where(free, r, 0).max(axis=1), -1)))]
        free[part[0]] = False
        tie = r[part[0]].copy()
        while len(part) < width:
            best = int(np.argmax(np.where(free, tie, -1)))
            part.append(best)
            free[best] = False
            tie += r[best]
        parts.append(sorted(part))
    return parts


def _within(differ: list[float], most: int) -> float:
    """Probability that at most so many of independent bits differ."""
    same = np.array([1.0])
    for d in differ:
        same = np.convolve(same, [1 - d, d])
    return float(same[: most + 1].sum())


def plan(both: np.ndarray, n: int, similarity: float = SIMILARITY, found: float = FOUND, unit: float = 0.02) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to use: the least estimated cost, filed rows and a fifth of the expected chance pairs, that finds a pair of the similarity with probability `found`."""
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 1 - 1e-6)
    parts = correlated_parts(both, n, part_width(n))
    need = math.ceil(-math.log(1 - found) / unit)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        options = {-1: (0.0, 0)}
        for t, rows in ((0, 1), (2, len(part) + 1)):
            miss = 1 - _within([turn(similarity)] * len(part), t)
            options[t] = (n * rows + 0.1 * n * n * _within(differ[part].tolist(), t), int(-math.log(max(miss, 1e-12)) / unit))
        after: dict[int, tuple[float, list[int]]] = {}
        for got, (spent, chosen) in best.items():
            for t, (cost, gain) in options.items():
                to = min(need, got + gain)
                if to not in after or spent + cost < after[to][0]:
                    after[to] = (spent + cost, [*chosen, t])
        best = after
    chosen = best[max(best)][1]
    return [(part, t) for part, t in zip(parts, chosen, strict=True) if t >= 0]


def _values(words: np.ndarray, parts: list[tuple[list[int], int]]) -> np.ndarray:
    """(fingerprints, parts): the value of each part."""
    bits = _bits(words)
    return np.stack([bits[:, part].astype(np.uint64) @ (np.uint64(1) << np.arange(len(part), dtype=np.uint64)) for part, _ in parts], axis=1)


def _key(values: np.ndarray, k: int) -> np.ndarray:
    return _mix(values * MULTIPLY + np.uint64(k + 1)).view(np.int64)


def _exact(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """key, id: each part's own value."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _values(_words_of(b), parts)
            keys = np.stack([_key(v[:, k], k) for k in range(len(parts))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b["id"].to_numpy(), len(parts)))], ["key", "id"])

    return nodes.mapInArrow(each, "key long, id long")


def _filed(nodes: DataFrame, parts: list[tuple[list[int], int]], crowded: np.ndarray) -> DataFrame:
    """key, salt, rank, id, w0: a row for each value that a fingerprint is filed under; only crowded values have salts other than 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                v = _values(_words_of(b), parts)
                keys = []
                for k, (part, t) in enumerate(parts):
                    flips = np.concatenate(([0], np.uint64(1) << np.arange(len(part), dtype=np.uint64))) if t else np.zeros(1)
                    keys.append(_key(v[:, k, None] ^ flips.astype(np.uint64), k))
                keys = np.concatenate(keys, axis=1)
                each_of = lambda c: np.repeat(b[c].to_numpy(), keys.shape[1])  # noqa: E731, B023
                ids, flat = each_of("id"), keys.ravel()
                salt = np.where(np.isin(flat, crowded), _mix(ids.view(np.uint64)) % np.uint64(SALTS), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flat, salt, each_of("rank"), ids, each_of("w0"))], ["key", "salt", "rank", "id", "w0"])

    return nodes.mapInArrow(each, "key long, salt int, rank long, id long, w0 long")


def candidate_ties(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: members of buckets and their leaders, if a first word of the fingerprints does not tell them apart."""
    both, n = bit_counts(nodes)
    parts = plan(both, n, similarity)
    share = turn(similarity)
    limit = math.ceil(64 * share + 3.5 * math.sqrt(64 * share * (1 - share)))
    exact = _exact(nodes, parts)
    shared = stored(exact.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rank = exact.join(shared, "key").groupBy("id").agg(F.sum("n").alias("rank"))
    nodes = nodes.join(rank, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    hot = shared.where(F.col("n") > CROWD).select("key").limit(LISTED + 1).toArrow()["key"].to_numpy()
    filed = _filed(nodes, parts, hot)  # beyond LISTED crowded values the others are left unsalted: slower, not wrong
    top = F.max(F.struct("rank", "id", "w0")).over(W.partitionBy("key", "salt"))
    led = filed.select("key", "salt", "id", "w0", top.alias("top")).where(F.col("id") != F.col("top.id"))
    far = F.bit_count(F.col("w0").bitwiseXOR(F.col("top.w0"))) > limit
    ties = led.where(~far).select(F.col("id").alias("a"), F.col("top.id").alias("b")).distinct()
    if not len(hot):
        return ties
    # Leaders of the salted parts of a crowded value are tied to the first of them.
    crowd = filed.where(F.col("key").isin(*hot.tolist()) if len(hot) <= 1000 else F.lit(True)).groupBy("key", "salt").agg(F.max(F.struct("rank", "id")).alias("top"))
    first = crowd.groupBy("key").agg(F.max("top").alias("first"))
    return ties.unionByName(crowd.join(first, "key").where("top.id <> first.id").select(F.col("top.id").alias("a"), F.col("first.id").alias("b"))).distinct()


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            h, n = shingle_sets(p["text"].tolist(), width)
            yield pd.DataFrame({"id": _ids(h, n), "hashes": [s.view(np.int64) for s in np.split(h, np.cumsum(n)[:-1])] if len(n) else []})

    return docs.select(F.col("text").cast("string")).mapInPandas(each, "id long, hashes array<long>")


def _sets_of(met: DataFrame, docs: DataFrame, every: DataFrame, width: int) -> DataFrame:
    """id, hashes: the whole sets of the ids in met. Only texts that have one of them are read again."""
    rows = every.join(met, "id").groupBy("id").agg(F.min("doc_id").alias("doc_id")).select(F.col("doc_id").alias("_id")).distinct()
    some = docs.join(rows, docs["doc_id"].cast("long").eqNullSafe(rows["_id"]), "left_semi")
    return stored(_sets(some, width).join(met, "id").groupBy("id").agg(F.first("hashes").alias("hashes")))


def verified(ties: DataFrame, docs: DataFrame, every: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ties whose sets are similar enough."""
    met = ties.select(F.col("a").alias("id")).unionByName(ties.select(F.col("b").alias("id"))).distinct()
    sets = _sets_of(met, docs, every, width)
    of = lambda c, name: sets.select(F.col("id").alias(c), F.col("hashes").alias(name))
    both = ties.join(of("b", "y"), "b").join(of("a", "x"), "a")
    overlap = F.size(F.array_intersect("x", "y"))
    return both.where(overlap >= similarity * (F.size("x") + F.size("y") - overlap) - 1e-9).select("a", "b")


def _first_shingles(docs: DataFrame, width: int, similarity: float, late: np.ndarray) -> DataFrame:
    """id, n (its size) and first: as many shingles of each set as it may lack and one more, and AHEAD of its size, by hash, those in `late` behind the others."""
    late = np.sort(late.view(np.uint64))

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            h, n = shingle_sets(p["text"].tolist(), width)
            if not len(n):
                continue
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, np.isin(h, late, kind="sort"), of)) if len(late) else np.arange(len(h))
            take = np.minimum(n, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1 + np.floor(AHEAD * n).astype(np.int64))
            begin = np.cumsum(n) - n
            yield pd.DataFrame({"id": _ids(h, n), "n": n, "first": [h[order[b : b + k]].view(np.int64) for b, k in zip(begin, take, strict=True)]})

    return docs.select(F.col("text").cast("string")).mapInPandas(each, "id long, n long, first array<long>")


def _mixed(filed: DataFrame) -> DataFrame:
    """h, c: the shingles that sets of different components hold, and how many sets do."""
    return filed.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c")).where("low <> high").select("h", "c")


def remaining_ties(docs: DataFrame, every: DataFrame, roots: DataFrame, width: int, similarity: float) -> DataFrame:
    """a, b: every two sets in different components whose sizes and first shingles allow the similarity. every: doc_id, id; roots: node, root."""
    plain = _first_shingles(docs, width, similarity, np.zeros(0, np.int64)).select(F.explode("first").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    # any list of late shingles gives the same ties in the end; a good one keeps chance meetings few
    late = plain.where(F.col("c") > FREQUENT).orderBy(F.desc("c"), "h").limit(LISTED).toArrow()["h"].to_numpy()
    first = _first_shingles(docs, width, similarity, late).join(roots, F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("root", "id").alias("comp"), "first")
    first = stored(first)
    filed = first.select("id", "comp", F.explode("first").alias("h"))
    # a set shares one more than the smaller of the two took ahead, and a partner has no fewer shingles than the set must share
    need = F.floor(AHEAD * F.ceil(similarity * F.col("n") - 1e-9)) + 1
    # no other set has a partner elsewhere; of those that may, all shingles are counted, which gives the order in which first shingles are rarest
    shared = filed.join(_mixed(filed).select("h"), "h").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    live = stored(first.select("id", "n", "comp").distinct().join(shared, "id").where(F.col("shared") >= need).select("id", "comp"))
    held = _sets_of(live.select("id"), docs, every, width).join(live, "id").select("id", "comp", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    own = W.partitionBy("id")
    # shingles of one component alone come before those that others hold, and those by how many sets do
    at = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "h")) - 1
    met = stored(held.join(stored(_mixed(held)), "h").withColumn("at", at).where(F.col("at") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9)).select("h", "id", "n", "comp", "at"))
    # the component that a shingle meets most is not paired with itself, so a large family costs its size
    most = met.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max(F.struct("c", "comp")).alias("m")).select("h", F.col("m.comp").alias("most"))
    few = met.join(most, "h").where("comp <> most").select("h", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"), F.col("at").alias("at_a"), "most")
    once = (F.col("comp") == F.col("most")) | (F.col("comp_a") < F.col("comp"))
    # behind the first shingle that two sets share, each has so many as they must share, or they are not similar
    enough = F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at")) >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n")) - 1e-9
    both = few.join(met, "h").where(once & (F.col("comp") != F.col("comp_a")) & enough)
    return both.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (the least doc_id that the row's text is tied to) for each row of docs."""
    every = stored(_described(docs, width))
    nodes = stored(every.groupBy("id").agg(*(F.first(f"w{k}").alias(f"w{k}") for k in range(WORDS))))
    ties = stored(candidate_ties(nodes, similarity))
    links = stored(verified(ties, docs, every, width, similarity))
    rest = stored(remaining_ties(docs, every, connected_components(links), width, similarity))
    roots = connected_components(links.unionByName(verified(rest, docs, every, width, similarity)))
    lows = every.groupBy("id").agg(F.min("doc_id").alias("low")).join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("comp"), "low")
    lows = stored(lows)
    least = lows.groupBy("comp").agg(F.min("low").alias("component_id"))
    return every.select("doc_id", "id").join(lows.join(least, "comp").select("id", "component_id"), "id").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose doc_id is their component's least, with all their columns; rows of a component without any doc_id stay."""
    d = components(docs, width, similarity).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(d, docs["doc_id"].cast("long").eqNullSafe(d["_id"]), "left_semi")
