"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node, which keeps its least ids. Nodes are put in ORDERS orders by the signs of random projections; blocks of
neighbours in an order give the first lists. Then NN-descent: each node's list and the nodes that list it are joined with their vectors, each pair of them with a fresh member is compared,
and whoever comes nearer than a node's worst neighbour enters its list, until few lists change. Nodes carry unit vectors as 16-bit integers, whose products are summed exactly, so a pair has one nearness wherever it is
computed. A query begins at its own node, if the index has its vector, and at the nearest of ENTRIES entries, and expands the nearest unexpanded nodes of its
beam, WIDE at once, until none is left; the best are scored on the original vectors in double precision.

Lists, reverse lists, blocks and beams are bounded, so nothing grows with a hub or a group of near copies; that and the graph make the search approximate. Measured recall of the five nearest is in the README; the tests hold it at 0.9 or more.

Vectors that are null, empty, zero, hold null or non-finite components or have another length than most take no part, nor does a null id. Of rows with one id the least vector counts. Ties go to the smaller id. Other
columns, whatever their names, are ignored. Empty tables, and queries against none but themselves, give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, seen_by_workers, stored
from .tokens import lots

LIST, REVERSE = 40, 40  # neighbours of a node; nodes that list it which join them
ORDERS, BLOCK, SIGNS = 8, 1024, 16  # orders by random projections, nodes compared at once in an order, hyperplanes of an order
BEAM, WIDE, ENTRIES = 128, 32, 1024  # nodes a search keeps, expands at once, and may begin at
ROUNDS, SETTLED = (2, 12), 0.2  # of the descent, least and most; it ends when a smaller share of neighbours is fresh
MOST_STEPS = 100  # of a search
RESCORED = 32  # best nodes of a search that are scored on original vectors
UNIT = 1 << 14  # length of a node's vector of 16-bit integers
BATCH = 8_000_000  # bytes of rows that a task joins at once
SEED = 7
LISTS = "node long, nbrs array<long>, sims array<int>, fresh array<boolean>"


class Index(NamedTuple):
    """classes: node, v, h, ids (the least `kept` ids of the node's vector). codes: node, code. graph: LISTS. links: node, nbrs (both ways)."""

    classes: DataFrame
    codes: DataFrame
    graph: DataFrame
    links: DataFrame
    width: int


def usable(rows: DataFrame, key: str, vector: str, width: int | None = None) -> DataFrame:
    """id, v, h: ids with vectors that take part; h is a hash of v."""
    v = F.col(vector).cast("array<double>")
    d = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & F.exists("v", lambda x: x != 0))
    d = d.where(F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))))
    if width is None:
        most = d.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
        width = most["width"] if most else 0
    one = d.where(F.size("v") == width).groupBy("id").agg(F.min("v").alias("v"))
    return one.withColumn("h", F.xxhash64("v"))


def units(v: pa.ListArray) -> np.ndarray:
    """Unit vectors of lists of doubles, one in a row."""
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # by a power of two, so no square overflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def coded(x: np.ndarray) -> pa.Array:
    raw = np.round(x * UNIT).astype("<i2")
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (raw.shape[1] * 2)), pa.py_buffer(raw)])


def decoded(code: pa.Array, width: int) -> np.ndarray:
    at = np.frombuffer(code.buffers()[1], np.int32)[code.offset]
    return np.frombuffer(code.buffers()[2], "<i2", offset=int(at), count=len(code) * width).reshape(-1, width).astype(float)


def lists_of(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, fresh: np.ndarray, most: int) -> pa.RecordBatch:
    """LISTS of the nearest of each node; a pair met again counts once, and is not fresh if it was known."""
    nodes, at = np.unique(node, return_inverse=True)
    order = np.lexsort((fresh, nbr, (at << 32) - sim))
    at, nbr, sim, fresh = at[order], nbr[order], sim[order], fresh[order]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (nbr[1:] != nbr[:-1])
    at, nbr, sim, fresh = at[first], nbr[first], sim[first], fresh[first]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < most
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(at[keep], minlength=len(nodes))))).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(nodes), *(pa.ListArray.from_arrays(offsets, pa.array(x[keep])) for x in (nbr, sim.astype(np.int32), fresh.astype(bool)))], ["node", "nbrs", "sims", "fresh"])


def flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    size = b["nbrs"].value_lengths().to_numpy()
    node, sims = np.repeat(b["node"].to_numpy(), size), b["sims"].flatten().to_numpy().astype(np.int64)
    return node, b["nbrs"].flatten().to_numpy(), sims, b["fresh"].flatten().to_numpy(zero_copy_only=False)


def whole(batches: Iterator[pa.RecordBatch], key: str, fold=None) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Lots of sorted rows in which no key is cut; what waits of a key is folded to less, if it can be."""
    held = None
    for b in lots(batches, BATCH):
        b = pa.concat_batches([held, b]) if held is not None else b
        keys = b[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield b.slice(0, cut)
        held = b.slice(cut)
        if fold and held.num_rows > 1:
            held = fold(held)
    if held is not None:
        yield held


def merged(parts: DataFrame, most: int = LIST) -> DataFrame:
    """LISTS of parts of LISTS, one row a node."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = lambda b: lists_of(*flat(b), most)
        for b in whole(batches, "node", fold):
            yield fold(b)

    return parts.repartition("node").sortWithinPartitions("node").mapInArrow(each, LISTS)


def first_lists(codes: DataFrame, width: int, most: int = LIST) -> DataFrame:
    """Parts of LISTS from blocks of each order."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).standard_normal((width, ORDERS * (SIGNS + 1)))
        for b in batches:
            side = (decoded(b["code"], width) @ planes / (UNIT * np.sqrt(width))).reshape(-1, ORDERS, SIGNS + 1)
            signs = (side[:, :, :SIGNS] > 0) @ (1 << np.arange(SIGNS)[::-1])
            keys = (signs << 32) + np.clip((side[:, :, SIGNS] + 8) * (1 << 28), 0, (1 << 32) - 1).astype(np.int64)
            for k in range(ORDERS):
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(k, pa.int32()), len(keys)), pa.array(keys[:, k]), b["node"], b["code"]], ["way", "key", "node", "code"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole(batches, "way"):
            ways, x, nodes = b["way"].to_numpy(), decoded(b["code"], width), b["node"].to_numpy()
            for way in np.unique(ways):
                a, z = np.searchsorted(ways, (way, way + 1)).tolist()
                for part in np.array_split(np.arange(a, z), -(-(z - a) // BLOCK)):
                    n = min(most, len(part) - 1)
                    if n < 1:
                        continue
                    s = (x[part] @ x[part].T).astype(np.int64)
                    np.fill_diagonal(s, -4 * UNIT * UNIT)  # below any other, and no number that overflows
                    top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(part) - 1 else np.argsort(-s, axis=1)[:, :n]
                    yield lists_of(np.repeat(nodes[part], n), nodes[part][top].ravel(), np.take_along_axis(s, top, 1).ravel(), np.ones(top.size, bool), most)

    dealt = codes.mapInArrow(ordered, "way int, key long, node long, code binary").repartitionByRange("way", "key").sortWithinPartitions("way", "key")
    return dealt.mapInArrow(blocks, LISTS)


def listed_by(graph: DataFrame, most: int, order: list) -> DataFrame:
    """node, nbr, fresh, sim: of the nodes that list a node, the first `most`."""
    pairs = graph.select("node", F.explode(F.arrays_zip("nbrs", "fresh", "sims")).alias("x")).select(F.col("x.nbrs").alias("node"), F.col("node").alias("nbr"), "x.fresh", F.col("x.sims").alias("sim"))
    return pairs.withColumn("place", F.row_number().over(W.partitionBy("node").orderBy(*order))).where(F.col("place") <= most).drop("place")


def descended(graph: DataFrame, codes: DataFrame, width: int, turn: int, most: int = LIST) -> DataFrame:
    """Parts of LISTS: what one round of neighbours' neighbours finds."""
    own = graph.select("node", F.explode(F.arrays_zip("nbrs", "fresh")).alias("x")).select("node", F.col("x.nbrs").alias("nbr"), "x.fresh")
    members = own.unionByName(listed_by(graph, REVERSE, [F.xxhash64("node", "nbr", F.lit(turn)), F.col("nbr")]).drop("sim"))
    worst = F.when(F.size("sims") < most, -UNIT * UNIT * 2).otherwise(F.element_at("sims", -1))
    known = codes.join(graph.select("node", worst.alias("worst")), "node", "left").select(F.col("node").alias("nbr"), "code", F.coalesce("worst", F.lit(-UNIT * UNIT * 2)).alias("worst"))
    rows = members.join(known, "nbr").select("node", "nbr", "fresh", "worst", "code").repartition("node").sortWithinPartitions("node", "nbr", F.desc("fresh"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole(batches, "node"):
            node, nbr = b["node"].to_numpy(), b["nbr"].to_numpy()
            first = np.ones(len(node), bool)
            first[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
            node, nbr, fresh, worst, x = node[first], nbr[first], b["fresh"].to_numpy(zero_copy_only=False)[first], b["worst"].to_numpy()[first], decoded(b["code"], width)[first]
            starts = np.concatenate((np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))), [len(node)]))
            found = []
            for k in range(0, len(starts) - 1, 64):  # lists padded to the longest of 64
                begin, end = starts[k : k + 64], starts[k + 1 : k + 65]
                begin = begin[: len(end)]
                size = end - begin
                at = begin[:, None] + np.minimum(np.arange(int(size.max())), size[:, None] - 1)
                there = np.arange(at.shape[1]) < size[:, None]
                v = x[at]
                s = np.matmul(v, v.transpose(0, 2, 1))
                new = fresh[at]
                good = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (s > worst[at][:, :, None])
                good &= ~np.eye(at.shape[1], dtype=bool)
                i, p, q = np.nonzero(good)
                found.append((at[i, p], at[i, q], s[i, p, q].astype(np.int64)))
            p, q, s = (np.concatenate(y) for y in zip(*found, strict=True))
            if len(p):
                yield lists_of(nbr[p], nbr[q], s, np.ones(len(p), bool), most)

    return rows.mapInArrow(each, LISTS)


def build(vectors: DataFrame, key: str, vector: str, kept: int = 6) -> Index:
    """The index of all rows that take part."""
    spark = vectors.sparkSession
    seen_by_workers(spark)
    rows = stored(usable(vectors, key, vector))
    some = rows.first()
    width = len(some["v"]) if some else 0
    least = rows.withColumn("place", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("place") <= kept)
    classes = stored(least.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("node"), "h", "v", "ids"))

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["node"], coded(units(b["v"]))], ["node", "code"])

    codes = stored(classes.select("node", "v").mapInArrow(to_codes, "node long, code binary"))
    with arrow_rows(spark, 10_000):
        graph = stored(merged(first_lists(codes, width)))
        for turn in range(ROUNDS[1]):
            known = graph.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
            graph = stored(merged(known.unionByName(stored(descended(graph, codes, width, turn)))))
            fresh, size = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("nbrs"))).first()
            if turn + 1 >= ROUNDS[0] and (fresh or 0) < SETTLED * (size or 1):
                break
    both = graph.select("node", F.explode("nbrs").alias("nbr")).unionByName(listed_by(graph, REVERSE, [F.desc("sim"), F.col("nbr")]).select("node", "nbr"))
    links = stored(both.groupBy("node").agg(F.collect_set("nbr").alias("nbrs")))
    return Index(classes, codes, graph, links, width)


def greedy(index: Index, queries: DataFrame) -> DataFrame:
    """q, c, sim, done: the beam of each query. queries: q, code, own (its node or null), stored."""
    spark, width = queries.sparkSession, index.width
    some = index.codes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).toArrow()  # ENTRIES rows at most
    entries = spark.sparkContext.broadcast((some["node"].to_numpy(), decoded(some["code"].combine_chunks(), width) if some.num_rows else np.zeros((0, width))))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, x = entries.value
        n = min(WIDE, len(nodes))
        for b in batches:
            if b.num_rows and n:
                s = decoded(b["code"], width) @ x.T
                top = np.argsort(-s, axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["q"].to_numpy(), n)), pa.array(nodes[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel().astype(np.int64))], ["q", "c", "sim"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["q"], b["c"], pa.array(np.einsum("ij,ij->i", decoded(b["code"], width), decoded(b["of"], width)).astype(np.int64))], ["q", "c", "sim"])

    order = W.partitionBy("q").orderBy(F.desc("sim"), "c")
    own = queries.where("own IS NOT NULL").select("q", F.col("own").alias("c"), F.lit(2 * UNIT * UNIT).cast("long").alias("sim"))
    beam = queries.select("q", "code").mapInArrow(begin, "q long, c long, sim long").join(own.select("q", "c"), ["q", "c"], "left_anti").unionByName(own).withColumn("done", F.lit(False))
    beam, met, codes = stored(beam), [], index.codes.withColumnRenamed("node", "c")
    met.append(beam.select("q", "c"))
    for _ in range(MOST_STEPS):
        front = stored(beam.where("NOT done").withColumn("place", F.row_number().over(order)).where(F.col("place") <= WIDE).select("q", "c"))
        if front.isEmpty():
            return beam
        seen = met[0]
        for m in met[1:]:
            seen = seen.unionByName(m)
        ahead = front.join(index.links.withColumnRenamed("node", "c"), "c").select("q", F.explode("nbrs").alias("c")).distinct().join(seen, ["q", "c"], "left_anti")
        scored = stored(ahead.join(codes, "c").join(queries.select("q", F.col("code").alias("of")), "q").mapInArrow(near, "q long, c long, sim long"))
        met.append(scored.select("q", "c"))
        marked = beam.join(front.withColumn("now", F.lit(True)), ["q", "c"], "left").select("q", "c", "sim", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        every = marked.unionByName(scored.withColumn("done", F.lit(False)))
        beam = stored(every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= BEAM).drop("place"))
    return beam


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int = 5, itself: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row; a row of the query's own id counts only if itself is asked for."""
    spark = queries.sparkSession
    seen_by_workers(spark)
    rows = stored(usable(queries, key, vector, index.width))
    asked = rows.groupBy("h", "v").agg(F.min("id").alias("q"))  # equal queries search once
    asked = stored(asked.join(index.classes.select("h", "v", F.col("node").alias("own")), ["h", "v"], "left"))

    def to_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["q"], coded(units(b["v"])), b["own"]], ["q", "code", "own"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for v in (b["v"], b["of"]))
                x, y = (np.ldexp(z, -np.frexp(np.abs(z).max(axis=1, keepdims=True))[1]) for z in (x, y))
                dot, xx, yy = (np.einsum("ij,ij->i", a, c) for a, c in ((x, y), (x, x), (y, y)))
                yield pa.RecordBatch.from_arrays([b["q"], b["ids"], pa.array(dot / (np.sqrt(xx) * np.sqrt(yy)))], ["q", "ids", "score"])

    with arrow_rows(spark, 10_000):
        beam = greedy(index, stored(asked.select("q", "v", "own").mapInArrow(to_codes, "q long, code binary, own long")))
        best = beam.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "c"))).where(F.col("place") <= RESCORED).select("q", F.col("c").alias("node"))
        pairs = best.join(index.classes.select("node", "v", "ids"), "node").join(asked.select("q", F.col("v").alias("of")), "q")
        scored = stored(pairs.select("q", "v", "of", "ids").mapInArrow(exact, "q long, ids array<long>, score double"))
    order = lambda by: W.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    found = scored.select("q", F.explode("ids").alias("vec_id"), "score").withColumn("place", F.row_number().over(order("q"))).where(F.col("place") <= k + 1).drop("place")
    of = rows.select(F.col("id").alias("query_id"), "h", "v").join(asked.select("h", "v", "q"), ["h", "v"]).select("query_id", "q")
    out = of.join(found, "q")
    if not itself:
        out = out.where("vec_id <> query_id")
    return out.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
