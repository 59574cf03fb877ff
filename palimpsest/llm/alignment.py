"""Alignment of two tokenizers' cuts of the same bytes: A is byte-level BPE over a space and the text, B a piece model over the text.

All texts of a lot lie one after another; token lengths give every token's end in that run of bytes. The ends of A and of B are counted once each
by bincount, and where both have one the texts are cut into groups. What belongs to a document follows from prefix sums between the
places where its bytes end. A link is the pair of the tokens that end at a cut.

Both tokens of a link end at the same byte, so the shorter's bytes end the longer's: there are at most most_pairs() different links, by
the vocabularies alone, however large the corpus. Their counts may therefore be sent to every task.

Null and empty texts, and texts that one of the tokenizers does not give back byte for byte, have no tokens: zeros and no groups. Strings of special tokens are
plain text. Very long texts go through whole, in a lot of their own. Repeated rows are aligned and counted each; a null doc_id stays null. Other columns, whatever their names, are
ignored. An empty table gives an empty result. Of links equally common for their B id each counts as best.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import seen_by_workers, stored
from .piece_dropout import library, pieces
from .tokens import UNSURE_BYTE, Encoder, lots

TOKENIZER_A = "byte_bpe_50k.json"
LOT = 4_000_000  # bytes of text aligned together, unless one text has more
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups binary, links binary, pairs binary, counts binary"


@functools.cache
def plain_tokenizer():  # noqa: ANN201
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(TOKENIZER_A))
    t.encode_special_tokens = True
    return t


def after_space(texts: pa.Array) -> pa.Array:
    none, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    return pc.binary_join_element_wise(none, texts, blank)


class Spaced(Encoder):
    """Ids of a space and each text; a text that is sure in itself stays so behind one space."""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unsure = pc.match_substring_regex(texts, UNSURE_BYTE)
        spaced = after_space(texts)
        if not pc.any(unsure).as_py():
            return self._cut(spaced)
        flat, n = self._cut(pc.filter(spaced, pc.invert(unsure)))
        sizes, odd = np.zeros(len(texts), np.int64), unsure.to_numpy(zero_copy_only=False)
        whole = [np.array(e.ids, flat.dtype) for e in plain_tokenizer().encode_batch_fast(pc.filter(spaced, unsure).to_pylist(), add_special_tokens=False)]
        sizes[~odd], sizes[odd] = n, [len(x) for x in whole]
        out, of = np.empty(int(sizes.sum()), flat.dtype), np.repeat(odd, sizes)
        out[~of], out[of] = flat, np.concatenate(whole)
        return out, sizes


class Bytes(NamedTuple):
    """The bytes of each id of a vocabulary."""

    raw: pa.Array
    size: np.ndarray

    @classmethod
    def of(cls, raw: list[bytes]) -> Bytes:
        return cls(pa.array(raw, pa.large_binary()), np.array([len(x) for x in raw], np.int64))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return values(self.raw.take(pa.array(ids)))


def values(texts: pa.Array) -> np.ndarray:
    """The bytes of a large string or binary array's values, one after another."""
    at = offsets(texts)
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] else np.zeros(0, np.uint8)


def offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


@functools.cache
def vocabularies() -> tuple[Bytes, Bytes]:
    """Bytes of A's ids (entries decoded by the byte-level alphabet) and of B's (pieces in UTF-8, the mark a space, byte pieces a byte)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(shown))}
    entries = plain_tokenizer().get_vocab(with_added_tokens=True)
    a = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        a[i] = bytes(byte[c] for c in entry)
    return Bytes.of(a), Bytes.of(pieces().raw)


def most_pairs() -> int:
    """No more links can differ: for each token, the tokens that its bytes end with have different lengths, or are a byte piece and its character."""
    a, b = vocabularies()
    return 2 * int(a.size.sum() + b.size.sum())


@functools.cache
def written() -> pa.Array:
    """Each id in decimal with what follows it: 4 * id for a comma, then a bar, a semicolon, nothing."""
    most = max(len(v.size) for v in vocabularies())
    return pa.array([f"{i}{mark}".encode() for i in range(most) for mark in (",", "|", ";", "")], pa.large_binary())


def sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n values each, by prefix sums."""
    before = np.concatenate(([0], np.cumsum(x)))
    ends = np.cumsum(n)
    return before[ends] - before[ends - n]


class Side(NamedTuple):
    """Ids of all texts, one after another, and how many each has."""

    ids: np.ndarray
    n: np.ndarray

    def of(self, keep: np.ndarray) -> Side:
        return Side(self.ids[np.repeat(keep, self.n)], self.n[keep])


class Cuts(NamedTuple):
    """ok: texts that both sides give back. For those: both sides, whether a token ends at a cut, and the number of groups."""

    ok: np.ndarray
    a: Side
    b: Side
    last_a: np.ndarray
    last_b: np.ndarray
    n_groups: np.ndarray


def cut(a: Side, b: Side, texts: pa.Array) -> Cuts:
    """Where A and B both end. texts: the bytes that both should give, as large strings."""
    size, raw = np.diff(offsets(texts)), values(texts)
    words = vocabularies()
    ok = np.ones(len(size), bool)
    for side, v in zip((a, b), words, strict=True):
        ok &= sums(v.size[side.ids], side.n) == size
    for side, v in zip((a, b), words, strict=True):
        mine = v.joined(side.of(ok).ids)
        differs = mine != (raw if ok.all() else raw[np.repeat(ok, size)])
        if differs.any():
            ok[ok] = sums(differs, size[ok]) == 0
    if not ok.all():
        a, b, size = a.of(ok), b.of(ok), size[ok]
    ends = [np.cumsum(v.size[side.ids]) for side, v in zip((a, b), words, strict=True)]
    total = int(size.sum()) + 1
    both = np.minimum(np.bincount(ends[0], minlength=total), np.bincount(ends[1], minlength=total)) > 0
    last_a, last_b = both[ends[0]], both[ends[1]]
    return Cuts(ok, a, b, last_a, last_b, sums(last_a, a.n))


def groups_of(c: Cuts) -> pa.Array:
    """`a1,a2|b1;a3|b2,b3` of each text, as large binary values."""
    at_a, at_b = (np.concatenate(([0], np.flatnonzero(x) + 1)) for x in (c.last_a, c.last_b))  # where groups begin
    in_a, in_b = (np.cumsum(x) - x for x in (c.last_a, c.last_b))  # the group of each token
    codes = np.empty(len(c.a.ids) + len(c.b.ids), np.int32)
    codes[np.arange(len(c.a.ids)) + at_b[in_a]] = c.a.ids.astype(np.int32) * 4 + c.last_a
    mark = c.last_b * 2
    mark[np.cumsum(c.b.n) - 1] = 3
    codes[np.arange(len(c.b.ids)) + at_a[in_b + 1]] = c.b.ids.astype(np.int32) * 4 + mark
    text = written().take(pa.array(codes))
    ends = offsets(text)[np.concatenate(([0], np.cumsum(c.a.n + c.b.n)))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(c.ok[c.ok]), [None, pa.py_buffer(ends.astype(np.int64)), text.buffers()[2]])


def add(pairs: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two counts of pairs as one."""
    every, which = np.unique(np.concatenate((pairs, more)), return_inverse=True)
    return every, np.bincount(which, np.concatenate((counts, n)), len(every)).astype(np.int64)


def aligned(docs: DataFrame, groups: bool = False) -> DataFrame:
    """ALIGNED, stored: a row for each document, links as 32-bit codes a * |B| + b, groups written out if asked for; and for each task a row of its pairs and their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kinds = Spaced(TOKENIZER_A, "byte"), len(vocabularies()[1].size)
        schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.binary()), ("links", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary())])
        pairs, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for b in lots(batches, LOT):
            texts = b["text"].cast(pa.large_string())
            some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
            live = pc.filter(texts, pa.array(some))
            numbers = np.zeros((3, len(texts)), np.int64)
            shas, said, links = [""] * len(texts), [None] * len(texts), np.zeros(0, np.uint32)
            if len(live):
                ids = library().encode(live.to_pylist(), num_threads=1)
                n_b = np.array([len(x) for x in ids], np.int64)
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(n_b.sum()))
                del ids
                c = cut(Side(*enc.encode(live)), Side(flat, n_b), after_space(live))
                at = np.flatnonzero(some)[c.ok]
                numbers[:, at] = c.a.n, c.b.n, c.n_groups
                text = groups_of(c)
                whole, ends = memoryview(values(text)), (offsets(text) - offsets(text)[0]).tolist()
                for k, x, y in zip(at.tolist(), ends[:-1], ends[1:], strict=True):
                    shas[k] = hashlib.sha256(whole[x:y]).hexdigest()
                    said[k] = bytes(whole[x:y]) if groups else None
                links = c.a.ids[c.last_a].astype(np.uint32) * np.uint32(kinds) + c.b.ids[c.last_b].astype(np.uint32)
                pairs, counts = add(pairs, counts, *np.unique(links, return_counts=True))
            where = np.concatenate(([0], np.cumsum(numbers[2]) * 4)).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(links, "<u4"))])
            nothing = pa.nulls(len(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x) for x in numbers), pa.array(shas), pa.array(said, pa.binary()), blobs, nothing, nothing], schema=schema)
        if len(pairs):
            yield pa.RecordBatch.from_pylist([{"pairs": pairs.astype("<u4").tobytes(), "counts": counts.astype("<i8").tobytes()}], schema=schema)

    seen_by_workers(docs.sparkSession)
    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, ALIGNED))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, a, b, n: how many links of the whole corpus hold each pair of ids. rows: of aligned()."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, n in zip(batch["pairs"], batch["counts"], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(p.as_buffer(), "<u4").astype(np.int64)), pa.array(np.frombuffer(n.as_buffer(), "<i8"))], ["pair", "n"])

    kinds = len(vocabularies()[1].size)
    counted = rows.where("pairs IS NOT NULL").select("pairs", "counts").mapInArrow(each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counted.select("pair", F.floor(F.col("pair") / kinds).alias("a"), (F.col("pair") % kinds).alias("b"), "n")


def scored(rows: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups of each document of aligned()."""
    spark, kinds = rows.sparkSession, len(vocabularies()[1].size)
    counted = pair_counts(rows).toArrow()  # at most most_pairs() rows
    if counted.num_rows > most_pairs():
        raise AssertionError("more pairs than the vocabularies allow")
    order = np.argsort(counted["pair"].to_numpy())
    pairs, n = counted["pair"].to_numpy()[order].astype(np.uint32), counted["n"].to_numpy()[order]
    highest = np.zeros(kinds, np.int64)
    np.maximum.at(highest, pairs % kinds, n)
    known = spark.sparkContext.broadcast((pairs, n, n == highest[pairs % kinds]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for b in batches:
            if not b.num_rows:
                continue
            links = b["links"]
            size = pc.binary_length(links).to_numpy().astype(np.int64) // 4
            flat = np.frombuffer(b"".join(links.to_pylist()), "<u4")
            at = np.searchsorted(pairs, flat)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_a"], b["n_b"], b["n_groups"], pa.array(size), pa.array(sums(best[at], size)), pa.array(sums(n[at], size)), b["groups_sha256"], b["groups"]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups binary"
    return rows.where("pairs IS NULL").select("doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256", "groups").mapInArrow(each, out)


def align(docs: DataFrame, groups: bool = False) -> DataFrame:
    """scored() rows of docs; groups as UTF-8 text if asked for, else null."""
    return scored(aligned(docs, groups))
