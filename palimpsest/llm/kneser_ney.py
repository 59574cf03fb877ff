"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Words (ASCII white space apart, A-Z lowered) and an end mark are 64-bit hashes. Three distributed counts: words;
then pairs of neighbours (a text begins with a start mark), sorted and summed in each task before they
move; then, from the merged pairs, each word's number of left neighbours and, as a context, its total and numbers
of pairs seen once, twice, more. Pairs are dealt by context into shards; a context that holds over a quarter of
a shard's pairs is spread over all shards by pair, so no word, however common, fills one
task. Each shard is a file of sorted arrays in the shared folder (spark.checkpoint.dir, which all workers see);
scoring tasks map the files and look up sorted, distinct keys, so pages are read in order and memory stays
bounded. The driver gets N, V, four counts of counts for each order, and the spread contexts (at most 4 for each shard).
The folder may be any that Arrow reaches by its address; files of one that is not mounted are read, not mapped.

log10 p(w | v) = log10(max(c(v, w) - D, 0) / c(v) + g(v) * q(w)), q the continuation unigram, itself
discounted and interpolated with 1 / (V + 1) for words never seen. A context never seen backs off to q.

Null text counts as empty (one end mark). A null doc_id counts as held out (its remainder is unknown). Repeated rows count each. Other
columns are ignored. An empty table gives an empty result; with no training text every word has probability 1 / (V + 1).
"""
from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_in, shared_dir, stored
from .tokens import lots

SHARD_BYTES = 12_000_000  # text bytes that one shard's pairs come from
MAPS = 96  # files that a worker holds open
SCORED = 6_000_000  # bytes of text whose tokens are looked up together, so that each shard is gone through once for them
FLUSH = 3_000_000  # tokens counted in a task before its pairs move on
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.concatenate(([1], np.cumprod(np.full(n, MULTIPLY, np.uint64), dtype=np.uint64))).astype(np.uint64)


def hashed_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text's followed by END, and the number of tokens of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    space = _SPACE[data]
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stop = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    owner = np.searchsorted(np.cumsum(size), begin, "right")
    n = np.bincount(owner, minlength=len(raw)).astype(np.int64)
    out = np.empty(len(begin) + len(raw), np.uint64)
    ends = np.cumsum(n + 1) - 1
    out[ends] = END
    if len(begin):
        width = stop - begin
        value = (_LOWER[data] + np.uint64(1)) * ~space
        power = _powers(max(63, 1 << int(width.max()).bit_length()))
        place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))[: len(data)] if begin[0] == 0 else np.concatenate((np.zeros(begin[0], np.int64), np.arange(begin[0], len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))))
        value *= power[np.minimum(place, len(power) - 1)]
        hashes = _mix(np.add.reduceat(value, begin) ^ width.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = np.where((hashes == END) | (hashes == START), hashes ^ np.uint64(1 << 63), hashes)
    return out, n + 1


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * MULTIPLY + _mix(right ^ np.uint64(0xA5A5A5A5A5A5A5A5)))


def _before(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each token's left neighbour."""
    left = np.concatenate(([START], tokens[:-1])).astype(np.uint64)
    left[np.concatenate(([0], np.cumsum(n)[:-1]))] = START
    return left


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


class Model(NamedTuple):
    """path: of the shard files; shards; spread: contexts dealt by pair; tokens N, vocabulary V; discounts of pairs and of continuation."""

    path: str
    shards: int
    spread: np.ndarray
    tokens: int
    vocabulary: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    continuations: int
    word_kinds: tuple[int, int, int]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder's file system, and the path in it: any that Arrow reaches by the same address as Spark."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _save(path: str, **arrays: np.ndarray) -> None:
    """Each array as a file of its own, put in place by renaming: a task that runs again, or twice, finds its file there and leaves it, as it would write the same."""
    fs, at = _store(path)
    for name, a in arrays.items():
        if _there(fs, f"{at}.{name}"):
            continue
        tmp = f"{at}.{name}.{TaskContext.get().taskAttemptId()}.tmp"
        with fs.open_output_stream(tmp) as f:
            f.write(np.ascontiguousarray(a).data)
        try:
            fs.move(tmp, f"{at}.{name}")
        except OSError:  # some stores do not replace a file
            if not _there(fs, f"{at}.{name}"):
                raise
            fs.delete_file(tmp)


def _there(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.File


def _batches(parts: Iterator[pd.DataFrame]) -> Iterator[list[str | None]]:
    for p in parts:
        texts = p["text"].tolist()
        for k in range(0, len(texts), 1000):
            yield texts[k : k + 1000]


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(keys + np.uint64(77)) % np.uint64(shards)).astype(np.int64)


def _dealt(shard: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if at[s] < at[s + 1]:
            yield s, [a[order[at[s] : at[s + 1]]].tobytes() for a in arrays]


def _by_shard(rows: DataFrame, shards: int, merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """merge of all rows of each shard. Shard k is partition k, so no task gets several by the chance of a hash."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held:
            for _, p in pd.concat(held).groupby("shard"):
                yield merge(p)

    return rows.repartitionById(shards, F.col("shard")).mapInPandas(each, schema)


def _count_words(shards: int):  # noqa: ANN202
    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pd.DataFrame:
            keys, n = _sum_by(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return pd.DataFrame([(s, *b) for s, b in _dealt(_shard_of(keys, shards), shards, keys, n.astype(np.uint32))], columns=["shard", "keys", "n"])

        size = 0
        for texts in _batches(parts):
            tokens, _ = hashed_tokens(texts)
            held.append(_sum_by(tokens, np.ones(len(tokens), np.int64)))
            size += len(held[-1][0])
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return each


def _merge_words(p: pd.DataFrame) -> pd.DataFrame:
    keys, n = _sum_by(np.frombuffer(b"".join(p["keys"]), np.uint64), np.frombuffer(b"".join(p["n"]), np.uint32).astype(np.int64))
    return pd.DataFrame({"shard": [int(p["shard"].iloc[0])], "keys": [keys.tobytes()], "n": [n.tobytes()], "distinct": [len(keys)], "total": [int(n.sum())]})


def _pair_shard(left: np.ndarray, keys: np.ndarray, spread: np.ndarray, shards: int) -> np.ndarray:
    shard = _shard_of(left, shards)
    if len(spread):
        wide = np.isin(left, spread)
        shard[wide] = _shard_of(keys[wide], shards)
    return shard


def _count_pairs(shards: int, spread: np.ndarray):  # noqa: ANN202
    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pd.DataFrame:
            left, right = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]))))
            n = np.diff(np.append(first, len(left))).astype(np.uint32)
            left, right = left[first], right[first]
            shard = _pair_shard(left, pair_keys(left, right), spread, shards)
            rows = []
            for s, (a, b, c) in _dealt(shard, shards, left, right, n):
                a = np.frombuffer(a, np.uint64)
                runs = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                rows.append((s, a[runs].tobytes(), np.diff(np.append(runs, len(a))).astype(np.uint32).tobytes(), b, np.minimum(np.frombuffer(c, np.uint32), 255).astype(np.uint8).tobytes(), c if max(np.frombuffer(c, np.uint32)) > 255 else b""))
            return pd.DataFrame(rows, columns=["shard", "left", "runs", "right", "n", "wide"])

        size = 0
        for texts in _batches(parts):
            tokens, n = hashed_tokens(texts)
            held.append((_before(tokens, n), tokens))
            size += len(tokens)
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return each


def _merge_pairs(shards: int, path: str):  # noqa: ANN202
    """Writes a shard's pairs; gives, by word shard, what its pairs say of words: left neighbours; total and pairs seen once, twice, more as a context."""

    def each(p: pd.DataFrame) -> pd.DataFrame:
        left = np.concatenate([np.repeat(np.frombuffer(a, np.uint64), np.frombuffer(r, np.uint32)) for a, r in zip(p["left"], p["runs"], strict=True)])
        n = np.concatenate([np.frombuffer(w, np.uint32) if len(w) else np.frombuffer(c, np.uint8) for c, w in zip(p["n"], p["wide"], strict=True)]).astype(np.int64)
        right = np.frombuffer(b"".join(p["right"]), np.uint64)
        order = np.argsort(pair_keys(left, right), kind="stable")
        left, right, n = left[order], right[order], n[order]
        keys = pair_keys(left, right)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.add.reduceat(n, first)
        left, right, keys = left[first], right[first], keys[first]
        _save(f"{path}/pairs-{int(p['shard'].iloc[0])}", keys=keys, n=n.astype(np.uint32))
        words = np.concatenate((right, left))
        zero, one = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
        stats = [np.concatenate(x) for x in ((one, zero), (zero, n), (zero, (n == 1) * one), (zero, (n == 2) * one), (zero, (n > 2) * one))]
        words, *stats = _sum_by(words, *stats)
        of_counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
        rows = [(s, *b, None) for s, b in _dealt(_shard_of(words, shards), shards, words, np.stack(stats, 1).astype(np.uint32))]
        return pd.DataFrame([*((*r[:3], None) for r in rows), (-1, None, None, [int(x) for x in of_counts])], columns=["shard", "keys", "stats", "of_counts"])

    return each


def _merge_stats(path: str):  # noqa: ANN202
    """Writes a word shard: keys, count, and the five numbers of _merge_pairs; gives the counts of continuation counts."""

    def each(p: pd.DataFrame) -> pd.DataFrame:
        shard = int(p["shard"].iloc[0])
        own = p[p["n"].notna()]
        keys = np.frombuffer(b"".join(own["keys"]), np.uint64)
        n = np.frombuffer(b"".join(own["n"]), np.int64)
        others = p[p["stats"].notna()]
        words = np.frombuffer(b"".join(others["keys"]), np.uint64)
        stats = np.frombuffer(b"".join(others["stats"]), np.uint32).reshape(-1, 5).astype(np.int64)
        every, count, *stats = _sum_by(np.concatenate((keys, words)), np.concatenate((n, np.zeros(len(words), np.int64))), *(np.concatenate((np.zeros(len(keys), np.int64), stats[:, k])) for k in range(5)))
        _save(f"{path}/words-{shard}", keys=every, stats=np.stack((count, *stats), 1).astype("<i8"))
        left = stats[0]
        got = [*np.bincount(np.minimum(left, 5), minlength=6)[1:5], left.sum(), (left > 0).sum(), (left == 1).sum(), (left == 2).sum(), (left > 2).sum()]
        return pd.DataFrame({"got": [[int(x) for x in got]]})

    return each


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of items seen once, twice, more, by the usual estimate from the counts of counts; 0.5, 1, 1.5 where that has none."""
    if min(n[:3]) < 1:
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(float(min(max(x, 0.01), k + 1 - 0.01)) for k, x in enumerate(d))


def train(docs: DataFrame) -> Model:
    """docs: the training rows, with text."""
    docs = docs.select(F.col("text").cast("string"))
    spark = docs.sparkSession
    shards = fit_in(docs.agg(F.sum(F.octet_length("text"))).first()[0], SHARD_BYTES, 24)
    path = shared_dir(spark)
    fs, at = _store(path)
    fs.create_dir(at)
    words = _by_shard(docs.mapInPandas(_count_words(shards), "shard int, keys binary, n binary"), shards, _merge_words, "shard int, keys binary, n binary, distinct long, total long")
    words = stored(words, "none")
    n, v = words.agg(F.sum("total"), F.sum("distinct")).first()
    n, v = n or 0, v or 0
    most = max(1, n // (4 * shards))

    def common(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for keys, c in zip(p["keys"], p["n"], strict=True):
                yield pd.DataFrame({"key": np.frombuffer(keys, np.uint64)[np.frombuffer(c, np.int64) > most].view(np.int64)})

    spread = [r[0] for r in words.select("keys", "n").mapInPandas(common, "key long").collect()]  # at most 4 * shards: each holds over N / (4 * shards)
    spread = np.sort(np.append(np.array(spread, np.int64).view(np.uint64), START))
    pairs = docs.mapInPandas(_count_pairs(shards, spread), "shard int, left binary, runs binary, right binary, n binary, wide binary")
    said = stored(_by_shard(pairs, shards, _merge_pairs(shards, path), "shard int, keys binary, stats binary, of_counts array<long>"), "none")
    of_pairs = [x or 0 for x in said.where("shard < 0").agg(*(F.sum(F.col("of_counts")[k]) for k in range(4))).first()]
    both = words.select("shard", "keys", "n", F.lit(None).cast("binary").alias("stats")).unionByName(said.where("shard >= 0").select("shard", "keys", F.lit(None).cast("binary").alias("n"), "stats"))
    got = stored(_by_shard(both, shards, _merge_stats(path), "got array<long>"))
    total = [x or 0 for x in got.agg(*(F.sum(F.col("got")[k]) for k in range(9))).first()]
    return Model(path, shards, spread, n, v, discounts(of_pairs), discounts(total[:4]), total[4], tuple(total[6:9]))


class _Mapped:
    """A model's files, mapped when they are first needed; of more than MAPS the one that was used longest ago is let go. A store that cannot be mapped is read into memory, by the same bound."""

    def __init__(self, model: Model):
        self.model, self.files, self.looked = model, OrderedDict(), 0  # looked: how often a shard was gone through
        self.fs, self.at = _store(model.path)

    def file(self, name: str, dtype: str, width: int = 1) -> np.ndarray:
        if name in self.files:
            self.files.move_to_end(name)
            return self.files[name]
        path = f"{self.at}/{name}"
        info = self.fs.get_file_info(path)
        if not info.size:
            a = np.zeros(0, dtype)
        elif isinstance(self.fs, pafs.LocalFileSystem):
            a = np.memmap(path, dtype, "r")
        else:
            with self.fs.open_input_file(path) as f:
                a = np.frombuffer(f.read(), dtype)
        self.files[name] = a.reshape(-1, width) if width > 1 else a
        while len(self.files) > MAPS:
            self.files.popitem(last=False)
        return self.files[name]

    def _look(self, kind: str, shard: np.ndarray, keys: np.ndarray, values: str, dtype: str, width: int) -> np.ndarray:
        out = np.zeros((len(keys), width), np.int64)
        order = np.argsort(shard, kind="stable")
        met, at = np.unique(shard[order], return_index=True)
        for s, mine in zip(met.tolist(), np.split(order, at[1:]), strict=True):  # shards that a key falls into; no other is opened
            there = self.file(f"{kind}-{s}.keys", "<u8")
            self.looked += 1
            if not len(there):
                continue
            k = np.minimum(np.searchsorted(there, keys[mine]), len(there) - 1)
            hit = there[k] == keys[mine]
            out[mine[hit]] = self.file(f"{kind}-{s}.{values}", dtype, width)[k[hit]].reshape(-1, width)
        return out

    def words(self, keys: np.ndarray) -> np.ndarray:
        """count, left neighbours, total and pairs seen once, twice, more as a context; keys sorted."""
        return self._look("words", _shard_of(keys, self.model.shards), keys, "stats", "<i8", 6)

    def pairs(self, left: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return self._look("pairs", _pair_shard(left, keys, self.model.spread, self.model.shards), keys, "n", "<u4", 1)[:, 0]


@functools.lru_cache(maxsize=1)
def _mapped_at(path: str) -> list:
    return []


def _mapped(model: Model) -> _Mapped:
    held = _mapped_at(model.path)
    if not held:
        held.append(_Mapped(model))
    return held[0]


def _off(d: tuple[float, float, float], n: np.ndarray) -> np.ndarray:
    return np.where(n == 0, 0.0, np.where(n == 1, d[0], np.where(n == 2, d[1], d[2])))


def score_tokens(model: Model, tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: whether training has it, log10 of its add-one share, log10 of its Kneser-Ney probability."""
    m = _mapped(model)
    left = _before(tokens, n)
    keys, place = np.unique(np.concatenate((tokens, left)), return_inverse=True)
    stats = m.words(keys)
    mine, ctx = stats[place[: len(tokens)]], stats[place[len(tokens) :]]
    count = mine[:, 0]
    base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
    d = model.word_discounts
    floor = 1 / (model.vocabulary + 1)
    if model.continuations:
        spare = sum(x * k for x, k in zip(d, model.word_kinds, strict=True)) / model.continuations
        q = (mine[:, 1] - _off(d, mine[:, 1])) / model.continuations + spare * floor
    else:
        q = np.full(len(tokens), floor)
    pk = pair_keys(left, tokens)
    pairs, at = np.unique(pk, return_index=True)
    back = np.searchsorted(pairs, pk)
    c = m.pairs(left[at], pairs)[back]
    d = model.pair_discounts
    total = ctx[:, 2]
    safe = np.maximum(total, 1)
    spare = (d[0] * ctx[:, 3] + d[1] * ctx[:, 4] + d[2] * ctx[:, 5]) / safe
    p = np.where(total > 0, (c - _off(d, c)) / safe + spare * q, q)
    return count > 0, base, np.log10(p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity for each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lots(batches, SCORED):
            tokens, n = hashed_tokens(b["text"].to_pylist())
            known, base, kn = score_tokens(model, tokens, n)
            at = np.concatenate(([0], np.cumsum(n)[:-1]))
            score = np.add.reduceat(kn, at)
            columns = [n, np.add.reduceat(known.astype(np.int64), at), np.add.reduceat(base, at), score, 10 ** np.minimum(-score / n, 300)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c) for c in columns)], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))
