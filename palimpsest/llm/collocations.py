"""Phrase collocations by suffix-sigma: every word's suffix of up to max_n words, counted once, gives the counts of all phrases.

Suffixes are counted within a lot of texts (a repeated passage costs one row a lot), shuffled by language and first word, and sorted reverse-lexicographically, so that all
suffixes that begin with a phrase stand together. One pass with a stack of open prefixes, one for each length, then counts all prefixes; the stack outlives lots,
so a run may be of any length. A suffix ends with a blank, so that no longer word stands between a phrase and its longer suffixes.

A first word that many suffixes share is dealt out by its second word, a hot pair by its third: a bounded list found on a sample (SAMPLE documents), which
steers the shuffle alone. Prefixes shorter than what is dealt out are then counted in parts, which the final sums put together. All counts are exact whatever the list holds.

Null texts count as empty, a null lang as und. Texts without words give nothing, repeated rows count each, ties are ranked by count and then by the phrase's bytes. Very long
texts are cut into suffixes whole, in a lot of their own. Other columns, whatever their names, are ignored. An empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, seen_by_workers, stored, text_or_empty
from .tokens import lots

BREAKS = ".,;:!?\n\x0b\x0c\r"
LOT = 4_000_000  # bytes of text whose suffixes are counted together
OUT = 100_000  # rows of a batch given back
SAMPLE, HOT = 5000, 1 / 2000  # documents that hot words are looked for in; the share of suffixes from which on a word or pair is hot: at most 2 / HOT are
SUFFIXES = "key string, salt long, n long"
COUNTS = "key string, words int, f long"

#: 0 in a word, 1 blank, 2 end of a piece; and letters A-Z lowered.
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = 1
KIND[list(BREAKS.encode())] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_in(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lowered words of large strings, one after another, and the number of each one's piece."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    begins = np.unique(at[:-1][np.diff(at) > 0] - at[0])
    kind = KIND[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    marks = (kind == 2).astype(np.int32)
    marks[begins] += 1
    piece = np.cumsum(marks, dtype=np.int32)[starts]
    sizes = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[inside])))
    return pc.dictionary_encode(words), piece


def suffixes_of(texts: pa.Array, max_n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The dictionary of words; the distinct suffixes as rows of word numbers, -1 behind the last; how often each is there."""
    coded, piece = words_in(texts)
    ids, bits = coded.indices.to_numpy(), len(coded.dictionary).bit_length()
    if bits * max_n > 63:
        return coded.dictionary, *_wide(ids, piece, max_n)
    code = (ids + 1).astype(np.int64) << bits * (max_n - 1)
    for k in range(1, max_n):  # one number, 0 behind the last word
        n = max(len(ids) - k, 0)
        code[:n] |= np.where(piece[:n] == piece[k:], ids[k:] + 1, 0).astype(np.int64) << bits * (max_n - 1 - k)
    code.sort()
    at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    one = code[at]
    rows = np.stack([(one >> bits * (max_n - 1 - k) & (1 << bits) - 1) - 1 for k in range(max_n)])
    return coded.dictionary, rows, np.diff(np.append(at, len(code)))


def _wide(ids: np.ndarray, piece: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and counts where a suffix's word numbers do not fit one integer."""
    rows = np.full((max_n, len(ids)), -1, np.int64)
    for k in range(max_n):
        n = max(len(ids) - k, 0)
        here = piece[:n] == piece[k:]
        rows[k, :n][here] = ids[k:][here]
    return np.unique(rows, axis=1, return_counts=True)


def hashed(words: pa.Array) -> np.ndarray:
    """A number for each of large strings, by its bytes alone."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]].astype(np.int64) + 1
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0], np.diff(at))
    return np.add.reduceat(raw * (place * 2_654_435_761 + 1_000_003), at[:-1] - at[0]) if len(raw) else np.zeros(len(words), np.int64)


def suffixes(docs: DataFrame, max_n: int, hot: tuple[str, ...] = ()) -> DataFrame:
    """SUFFIXES of lang and text. key: the lang (blanks and tabs in it as %20 and %09), a tab, a digit, the words with a blank behind each. The digit is the least length of which this row's prefix is counted in one place: 1, or 2 and 3 behind a hot word and pair, which salt deals out by what follows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        for b in lots(batches, LOT):
            for lang in pc.unique(b["lang"]).to_pylist():
                words, rows, n = suffixes_of(pc.filter(b["text"], pc.equal(b["lang"], lang)), max_n)
                salt, whole = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
                heads = [h.split("\t")[1].split(" ") for h in hot if h.startswith(f"{lang}\t")]
                if heads:
                    marks = np.append(hashed(words), 0)
                    found = lambda k, size: pc.index_in(pa.array([h[k] for h in heads if len(h) == size], pa.large_string()), words)
                    warm = np.zeros(len(words), bool)
                    warm[found(0, 1).drop_null().to_numpy()] = True
                    at = np.flatnonzero(warm[rows[0]])
                    whole[at], salt[at] = 2, marks[rows[1, at]]
                    if max_n > 2:
                        first, last = found(0, 2), found(1, 2)
                        there = pc.and_(first.is_valid(), last.is_valid())
                        pairs = pc.filter(first, there).to_numpy().astype(np.int64) << 32 | pc.filter(last, there).to_numpy()
                        at = at[np.isin(rows[0, at] << 32 | rows[1, at], pairs) & (rows[1, at] >= 0)]
                        whole[at], salt[at] = 3, salt[at] * 31 + marks[rows[2, at]]
                head = pa.array([f"{lang}\t{k}" for k in range(4)], pa.large_string())
                for k in range(0, len(n), OUT):
                    cut = slice(k, k + OUT)
                    first = pc.binary_join_element_wise(head.take(pa.array(whole[cut])), words.take(pa.array(rows[0, cut])), none)
                    joined = pc.binary_join_element_wise(first, *(words.take(pa.array(r[cut], mask=r[cut] < 0)) for r in rows[1:]), none, blank, null_handling="skip")
                    yield pa.RecordBatch.from_arrays([joined.cast(pa.string()), pa.array(salt[cut]), pa.array(n[cut].astype(np.int64))], ["key", "salt", "n"])

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    for x in "% \t":
        lang = F.replace(lang, F.lit(x), F.lit(f"%{ord(x):02X}"))
    return docs.select(lang.alias("lang"), text_or_empty().alias("text")).mapInArrow(each, SUFFIXES)


def hot_heads(docs: DataFrame, sample: int = SAMPLE, share: float = HOT) -> tuple[str, ...]:
    """Words and pairs of words, behind lang and tab, that begin a share of a sample's suffixes: at most 1 / share words and as many pairs."""
    n = docs.count()
    some = docs if n <= sample else docs.sample(sample / n, seed=1)
    heads = F.array(*(F.struct(F.lit(k).alias("k"), F.substring_index("key", " ", k).alias("head")) for k in (1, 2)))
    found = suffixes(some, 2).withColumn("key", F.regexp_replace("key", "\t1", "\t")).select("n", F.explode(heads).alias("x")).groupBy("x").agg(F.sum("n").alias("n"))
    total = found.where("x.k = 1").agg(F.sum("n")).first()[0] or 0
    many = found.where((F.col("n") >= share * total) & ((F.col("x.k") == 1) | F.col("x.head").contains(" ") & ~F.col("x.head").endswith(" "))).select("x.head").collect()
    return tuple(sorted(r["head"] for r in many))


class Stack:
    """Counts of open prefixes, one for each length, over lots of sorted suffixes."""

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least = max_n, least
        self.open: list[tuple[str, int, int] | None] = [None] * max_n  # key, whole, count

    def put(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Prefixes that end within b; and for each lang a row of no words with the suffixes of b."""
        n = b["n"].to_numpy()
        lists = pc.split_pattern(b["key"], " ")
        begin = lists.offsets.to_numpy()
        size, begin, flat = np.diff(begin) - 1, begin[:-1] - begin[0], lists.flatten()
        words = pc.dictionary_encode(flat).indices.to_numpy()
        new = np.ones(len(n), bool)
        new[1:] = False
        blank, gone = pa.scalar(" "), []
        for k in range(self.max_n):
            has = size > k
            w = words[np.minimum(begin + k, len(words) - 1)]
            new[1:] |= w[1:] != w[:-1]
            new |= ~has
            starts = np.flatnonzero(new)
            f = np.add.reduceat(n, starts)
            keys = lambda at, k=k: pc.binary_join_element_wise(*(flat.take(pa.array(begin[at] + j)) for j in range(k + 1)), blank) if k else flat.take(pa.array(begin[at]))
            if not k:
                heads = pc.split_pattern(keys(starts), "\t", max_splits=1)
                yield from self.totals(pc.list_element(heads, 0), f)
                group = np.cumsum(new) - 1  # the first word's run of each row
                whole = pc.utf8_slice_codeunits(pc.list_element(heads, 1), 0, 1).cast(pa.int64()).to_numpy()
            real = has[starts]
            starts, f = starts[real], f[real]
            if self.open[k]:
                key, w0, before = self.open[k]
                if len(f) and starts[0] == 0 and keys(starts[:1])[0].as_py() == key:
                    f[0] += before
                else:
                    gone.append((k, key, w0, before))
            done = (f >= self.least) | (whole[group[starts]] > k + 1)
            self.open[k] = None
            if has[-1]:
                self.open[k] = (keys(starts[-1:])[0].as_py(), int(whole[group[starts[-1]]]), int(f[-1]))
                done[-1] = False
            yield pa.RecordBatch.from_arrays([keys(starts[done]), pa.array(np.full(int(done.sum()), k + 1, np.int32)), pa.array(f[done])], ["key", "words", "f"])
        yield from self.rows(gone)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.rows([(k, *x) for k, x in enumerate(self.open) if x])

    def rows(self, gone: list[tuple[int, str, int, int]]) -> Iterator[pa.RecordBatch]:
        for k, key, whole, f in gone:
            if f >= self.least or whole > k + 1:
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k + 1], pa.int32()), pa.array([f], pa.int64())], ["key", "words", "f"])

    def totals(self, langs: pa.Array, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        coded = pc.dictionary_encode(langs)
        sums = np.bincount(coded.indices.to_numpy(), f, len(coded.dictionary)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.zeros(len(sums), np.int32)), pa.array(sums)], ["key", "words", "f"])


def phrase_counts(docs: DataFrame, max_n: int = 3, least: int = 10) -> DataFrame:
    """lang, phrase, words, f, stored: phrases of up to max_n words with f >= least; and for each lang a row of no words without a phrase, whose f is the number of its words."""
    spark = docs.sparkSession
    seen_by_workers(spark)
    dealt = suffixes(docs, max_n, hot_heads(docs)).repartition(F.substring_index("key", " ", 1), "salt").sortWithinPartitions(F.desc("key"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, least)
        for b in lots(batches, LOT):
            yield from stack.put(b)
        yield from stack.rest()

    with arrow_rows(spark, 100_000):
        parts = stored(dealt.select("key", "n").mapInArrow(each, COUNTS))
    parts = parts.withColumn("key", F.regexp_replace("key", "\t[0-9]", "\t"))
    lang = F.substring_index("key", "\t", 1)
    for x in "\t %":
        lang = F.replace(lang, F.lit(f"%{ord(x):02X}"), F.lit(x))
    counted = parts.groupBy("key", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))
    return counted.select(lang.alias("lang"), F.when(F.col("words") > 0, F.expr("substr(key, instr(key, '\t') + 1)")).alias("phrase"), "words", "f")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best of each lang's phrases of 2 to max_n words, scored by their worst cut.

    A phrase goes if a longer candidate that holds its words has inside per cent of its count or more.
    """
    counted = stored(phrase_counts(docs, max_n, least))
    totals = counted.where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    part = counted.where("phrase IS NOT NULL").select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    every = counted.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    text = lambda w: F.array_join(w, " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), text(F.slice("w", F.lit(1), k)).alias("first"), text(F.slice("w", k + 1, F.col("words") - k)).alias("last")))
    cut = every.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    cut = cut.join(part.withColumnsRenamed({"part": "first", "of": "l"}), ["lang", "first"]).join(part.withColumnsRenamed({"part": "last", "of": "r"}), ["lang", "last"])
    score = F.expr("CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    worst = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # contiguous parts of two words or more of each longer candidate
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: text(F.slice("w", i, k)))))
    longer = every.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), F.asc("phrase"))
    best = kept.select("lang", "phrase", "a", "s", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "s.l", "s.r", "n", "s.score")
