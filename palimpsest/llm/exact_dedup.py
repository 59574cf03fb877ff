"""Exact deduplication with a minimal perfect hash over the distinct digests of history.

The digest of a text is the SHA-256 of its UTF-8 form with each run of ASCII white space as one
space. The distinct digests of history are dealt by their first bytes into shards of about
SHARD digests; each shard's index is a minimal perfect hash (hash and displace: keys fall into small
buckets, and each bucket gets the first seed that sends its keys to free slots) whose slots hold the
full digest, the winner's doc_id and the number of rows. New digests are looked up: the slot's
bytes are compared with the digest, so no stranger is ever taken for a member. Members join the
slot's group; the others form groups of their own.

Null text counts as empty. A null doc_id loses to any other. Of equal texts the row of the
smallest doc_id stays; of rows that repeat both doc_id and text one stays. Texts of any length cost the memory of one row. Other
columns are ignored, an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import boxed, fit_in, stored, text_or_empty, unboxed

SHARD = 1 << 18
LOAD = 3  # keys of a bucket, on average
NULL_ID = -(1 << 63)
INDEX = "shard int, n long, seeds binary, digests binary, winners binary, counts binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\x09-\\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(normalised(text_or_empty()).cast("binary"), 256)).alias("digest"))


def _mix(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    x = x ^ (seed * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The second and third eight bytes of each digest (the first choose the shard)."""
    rows = np.frombuffer(blob, "<u8").reshape(-1, 4)
    return rows[:, 1].copy(), rows[:, 2].copy()


def build_mph(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Seeds by bucket, and the slot of each digest; slots are 0..n-1, each used once.

    Buckets of one size, the largest first, try the same seed at once; of those that want one slot the first gets it."""
    a, b = _keys(blob)
    n = len(a)
    buckets = max(1, -(-n // LOAD))
    of = (a % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    size = np.bincount(of, minlength=buckets)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    seeds, slot, used = np.zeros(buckets, np.uint32), np.full(n, -1, np.int64), np.zeros(n, bool)
    for s in range(int(size.max()) if n else 0, 1, -1):
        todo = np.flatnonzero(size == s)
        rows = order[start[todo][:, None] + np.arange(s)]
        seed = 0
        while len(todo):
            seed += 1
            to = (_mix(b[rows], np.full(1, seed, np.uint64)) % np.uint64(n)).astype(np.int64)
            ordered = np.sort(to, axis=1)
            fit = np.flatnonzero(~used[to].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            wanted = to[fit].ravel()
            won = np.zeros(len(wanted), bool)
            won[np.unique(wanted, return_index=True)[1]] = True
            fit = fit[won.reshape(-1, s).all(axis=1)]
            used[to[fit]] = True
            seeds[todo[fit]], slot[rows[fit]] = seed, to[fit]
            rest = np.ones(len(todo), bool)
            rest[fit] = False
            todo, rows = todo[rest], rows[rest]
    single = np.flatnonzero(size == 1)  # a bucket of one names a free slot outright
    free = np.flatnonzero(~used)
    seeds[single] = free.astype(np.uint32) | np.uint32(1 << 31)
    slot[order[start[single]]] = free
    return seeds, slot


def find_mph(seeds: np.ndarray, n: int, blob: bytes) -> np.ndarray:
    """The slot at which each digest would be; the caller compares the bytes."""
    a, b = _keys(blob)
    seed = seeds[(a % np.uint64(len(seeds))).astype(np.int64)]
    direct = seed >> np.uint32(31) == 1
    hashed = (_mix(b, seed.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
    return np.where(direct, (seed & np.uint32(0x7FFFFFFF)).astype(np.int64), hashed)


def _grouped(d: DataFrame, shards: int) -> DataFrame:
    """One row for each digest: shard, digest, winner, n."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    return d.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("n")).select(shard.alias("shard"), "digest", F.coalesce("winner", F.lit(NULL_ID)).alias("winner"), "n")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    blob = b"".join(pdf["digest"])
    seeds, slot = build_mph(blob)
    n = len(pdf)
    held, winners, counts = np.empty((n, 32), np.uint8), np.empty(n, np.int64), np.empty(n, np.int64)
    held[slot] = np.frombuffer(blob, np.uint8).reshape(-1, 32)
    winners[slot], counts[slot] = pdf["winner"].to_numpy(), pdf["n"].to_numpy()
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [n], "seeds": [seeds.tobytes()], "digests": [held.tobytes()], "winners": [winners.tobytes()], "counts": [counts.tobytes()]})


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history: digests(). A row of binary arrays for each shard."""
    return _grouped(history, shards).repartition(shards, "shard").groupBy("shard").applyInPandas(_build, INDEX)


def _min_id(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a == NULL_ID, b, np.where(b == NULL_ID, a, np.minimum(a, b)))


def _look(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    rows = [new["digest"].to_numpy(), new["winner"].to_numpy(np.int64), new["n"].to_numpy(np.int64)]
    if not len(index):
        return pd.DataFrame({"digest": rows[0], "keep_id": rows[1], "group_size": rows[2], "known": False})
    x = index.iloc[0]
    n, held = int(x["n"]), np.frombuffer(x["digests"], np.uint8).reshape(-1, 32)
    winners, counts = np.frombuffer(x["winners"], np.int64).copy(), np.frombuffer(x["counts"], np.int64).copy()
    out = []
    if len(new):
        blob = b"".join(rows[0])
        slot = find_mph(np.frombuffer(x["seeds"], np.uint32), n, blob)
        slot = np.minimum(slot, n - 1)
        member = (held[slot] == np.frombuffer(blob, np.uint8).reshape(-1, 32)).all(axis=1)
        mine = slot[member]
        winners[mine] = _min_id(winners[mine], rows[1][member])
        counts[mine] += rows[2][member]
        out.append(pd.DataFrame({"digest": rows[0][~member], "keep_id": rows[1][~member], "group_size": rows[2][~member], "known": False}))
    out.append(pd.DataFrame({"digest": [r.tobytes() for r in held], "keep_id": winners, "group_size": counts, "known": True}))
    return pd.concat(out)


def look_up(index: DataFrame, new: DataFrame, shards: int) -> DataFrame:
    """digest, keep_id, group_size, known: a row for each distinct digest of the index and of new."""
    found = index.groupBy("shard").cogroup(_grouped(new, shards).groupBy("shard")).applyInPandas(_look, "digest binary, keep_id long, group_size long, known boolean")
    return found.withColumn("keep_id", F.when(F.col("keep_id") != NULL_ID, F.col("keep_id")))


def exact_groups(docs: DataFrame, is_history: Column) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, digest. Rows of is_history make the index; null there is new."""
    d = stored(digests(docs.withColumn("doc_id", F.col("doc_id").cast("long"))))
    old = F.coalesce(is_history, F.lit(False))
    shards = fit_in(d.count(), SHARD, 64)
    index = stored(build_index(d.where(old), shards))
    groups = look_up(index, d.where(~old), shards)
    # Repeated rows are counted first: after the join by digest nothing needs its partitions, so that a hot digest's can be split.
    rows = d.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    out = rows.join(groups, "digest").select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("place"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).drop("rows", "place")


def drop_exact_copies(docs: DataFrame, is_history: Column) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    stay = exact_groups(docs, is_history).where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"))
    d = boxed(docs).withColumn("_digest", F.unhex(F.sha2(normalised(text_or_empty()).cast("binary"), 256)))
    d = d.join(stay, d["doc_id"].cast("long").eqNullSafe(stay["_id"]) & (d["_digest"] == stay["_d"]))
    return unboxed(d.withColumn("_n", F.row_number().over(W.partitionBy("_id", "_d").orderBy(F.lit(0)))).where("_n = 1"), docs)
