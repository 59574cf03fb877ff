"""Public tokenizers inside tasks: whole texts to id arrays, with a bounded store of the ids of space-separated chunks.

A chunk is cut only where the tokenizer's own pre-tokenizer cuts anyway; texts for which that is not sure (rare white
space, strings of special tokens) are given to the library whole. The HOT chunks that a worker has met most often are found
by Arrow's hash table; the others reach the library, each distinct one of a lot once and many in one call.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HOT, PENDING = 120_000, 200_000  # chunks in Arrow's table; chunks that wait to be ranked against them
TOGETHER = 1000  # chunks in one call's text
LOT = 8_000_000  # bytes of text encoded together, if the caller has as many
DTYPE = np.dtype("<u2")  # both vocabularies have fewer than 65,536 ids

#: Texts that are not cut: white space other than space and newline, white space at an end or next to white space, special tokens.
UNSURE_BYTE = "[\\x00\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$|(?i)<\\|"
#: The word tokenizer lowers letters: one to one in Latin-1, where no mark joins the character before it. The library may not take these controls for white space.
UNSURE_WORD = "[^\\x00-\\x{ff}]|[\\x00\\x1c-\\x1f\\x{85}]|<\\|"


@functools.cache
def tokenizer(name: str):  # noqa: ANN201
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def _ragged(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at start, one after another."""
    ends = np.cumsum(size)
    return ids[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Runs(NamedTuple):
    """Runs of ids."""

    ids: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def plus(self, other: _Runs) -> _Runs:
        return _Runs(np.concatenate((self.ids, other.ids)), np.concatenate((self.start, other.start + len(self.ids))), np.concatenate((self.size, other.size)))

    def take(self, which: np.ndarray) -> _Runs:
        size = self.size[which]
        return _Runs(_ragged(self.ids, self.start[which], size), np.cumsum(size) - size, size)


class Encoder:
    """by: "byte" keeps the space with the word after it, "word" drops white space."""

    def __init__(self, name: str, by: str):
        self.name, self.by = name, by
        # Between chunks of one call: a pre-token of its own, which no chunk that is joined by it contains.
        self.between = "\n" if by == "byte" else " | "
        self.mark = self._whole(self.between)[0]
        self.hot, self.runs, self.met = pa.array([], pa.large_string()), self._each([]), np.zeros(0, np.int64)
        self.waiting: list[tuple[pa.Array, _Runs, np.ndarray]] = []

    def _whole(self, text: str) -> list[int]:
        return tokenizer(self.name).encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _each(self, texts: list[str]) -> _Runs:
        ids = [np.array(self._whole(t), DTYPE) for t in texts]
        size = np.array([len(x) for x in ids], np.int64)
        return _Runs(np.concatenate([np.zeros(0, DTYPE), *ids]), np.cumsum(size) - size, size)

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        if self.by == "word":
            return pc.utf8_split_whitespace(pc.utf8_lower(texts))
        apart = pc.replace_substring(pc.replace_substring(texts, "\n", "\x00\n\x00"), " ", "\x00 ")
        return pc.split_pattern(apart, "\x00")

    def _library(self, chunks: pa.Array) -> _Runs:
        """Ids of distinct chunks. ASCII letters are one pre-token, which goes to the library's model at once; others go many in one text."""
        kind = np.zeros(len(chunks), np.int64)
        kind[pc.or_(pc.match_substring(chunks, self.between.strip(" ")), pc.equal(pc.binary_length(chunks), 0)).to_numpy(zero_copy_only=False)] = 1
        kind[pc.match_substring_regex(chunks, "^ ?[A-Za-z]+$" if self.by == "byte" else "^[a-z]+$").to_numpy(zero_copy_only=False)] = 2
        of = [pc.filter(chunks, pa.array(kind == k)) for k in range(3)]
        out = self._joined(of[0]).plus(self._each(of[1].to_pylist())).plus(self._letters(of[2].to_pylist()))
        order = np.empty(len(chunks), np.int64)
        order[np.argsort(kind, kind="stable")] = np.arange(len(chunks))
        return _Runs(out.ids, out.start[order], out.size[order])

    def _joined(self, plain: pa.Array) -> _Runs:
        cuts = np.append(np.arange(0, len(plain), TOGETHER), len(plain))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), plain), pa.scalar(self.between, pa.large_string())).to_pylist() if len(plain) else []
        # A mark at the end of each text makes the ends of all chunks the places of marks.
        ids = np.concatenate([np.zeros(0, DTYPE), *(np.array([*e.ids, self.mark], DTYPE) for e in tokenizer(self.name).encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.flatnonzero(ids == self.mark)
        start = np.append(0, ends[:-1] + 1) if len(ends) else ends
        return _Runs(ids, start, ends - start)

    def _letters(self, words: list[str]) -> _Runs:
        model, flat, sizes = tokenizer(self.name).model.tokenize, [], []
        for w in words:
            got = [t.id for t in model("Ġ" + w[1:] if w[0] == " " else w)]  # the byte-level alphabet's space
            flat += got
            sizes.append(len(got))
        size = np.array(sizes, np.int64)
        return _Runs(np.array(flat, DTYPE), np.cumsum(size) - size, size)

    def _rare(self, chunks: pa.Array) -> _Runs:
        """Ids of distinct chunks that are not hot. A comma or full stop after a letter is a pre-token of its own, so the chunk before it is looked for alone."""
        ended = pc.match_substring_regex(chunks, "\\pL[.,]$")
        coded = pc.dictionary_encode(pc.if_else(ended, pc.utf8_slice_codeunits(chunks, 0, -1), chunks))
        known = pc.index_in(coded.dictionary, value_set=self.hot)
        new = pc.is_null(known)
        runs = self.runs.plus(self._library(pc.filter(coded.dictionary, new)))
        at = pc.fill_null(known, 0).to_numpy().astype(np.int64)
        new = new.to_numpy(zero_copy_only=False)
        at[new] = len(self.hot) + np.arange(int(new.sum()))
        runs = runs.take(at[coded.indices.to_numpy()])
        if not pc.any(ended).as_py():
            return runs
        last = pc.utf8_slice_codeunits(chunks, -1)
        ends = np.cumsum(runs.size)
        ids, size = runs.ids, runs.size.copy()
        place, what = [], []
        for mark in ".,":
            mine = pc.and_(ended, pc.equal(last, mark)).to_numpy(zero_copy_only=False)
            place.append(ends[mine])
            what.append(np.full(int(mine.sum()), self._whole(mark)[0], DTYPE))
            size[mine] += 1
        return _Runs(np.insert(ids, np.concatenate(place), np.concatenate(what)), np.cumsum(size) - size, size)

    def _rank(self) -> None:
        """The chunks met most often become the hot ones."""
        words = pa.concat_arrays([self.hot, *(w[0] for w in self.waiting)])
        runs, met = self.runs, np.concatenate([self.met, *(w[2] for w in self.waiting)])
        for w in self.waiting:
            runs = runs.plus(w[1])
        coded = pc.dictionary_encode(words)
        codes = coded.indices.to_numpy()
        total = np.bincount(codes, met)
        order = np.argsort(-total, kind="stable")[:HOT]
        first = np.empty(len(total), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        self.hot, self.runs, self.met, self.waiting = coded.dictionary.take(pa.array(order)), runs.take(first[order]), total[order].astype(np.int64), []

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self._chunks(texts)
        chunks = lists.flatten()
        found = pc.index_in(chunks, value_set=self.hot)
        at = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        runs, n = self.runs, len(self.hot)
        if found.null_count:
            unmet = pc.is_null(found)
            coded = pc.dictionary_encode(pc.filter(chunks, unmet))
            rare, codes = self._rare(coded.dictionary), coded.indices.to_numpy()
            runs = runs.plus(rare)
            unmet = unmet.to_numpy(zero_copy_only=False)
            at[unmet] = n + codes
            self.waiting.append((coded.dictionary, rare, np.bincount(codes)))
            self.met += np.bincount(at[~unmet], minlength=n)
        else:
            self.met += np.bincount(at, minlength=n)
        size = runs.size[at]
        flat = _ragged(runs.ids, runs.start[at], size)
        cuts = lists.offsets.to_numpy()
        if sum(len(w[0]) for w in self.waiting) > (PENDING if len(self.hot) >= HOT else len(self.hot)):
            self._rank()
        return flat, np.diff(np.concatenate(([0], np.cumsum(size)))[cuts - cuts[0]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        unsure = pc.match_substring_regex(texts, UNSURE_BYTE if self.by == "byte" else UNSURE_WORD)
        if not pc.any(unsure).as_py():
            return self._cut(texts)
        flat, n = self._cut(pc.filter(texts, pc.invert(unsure)))
        parts = iter(np.split(flat, np.cumsum(n)[:-1])) if len(n) else iter(())
        whole = unsure.to_pylist()
        out = [np.array(self._whole(t.as_py()), DTYPE) if odd else next(parts) for t, odd in zip(texts, whole, strict=True)]
        return np.concatenate(out), np.array([len(x) for x in out])


def lots(batches: Iterator[pa.RecordBatch], most: int = LOT) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many bytes; none is empty."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if held and sum(x.nbytes for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@functools.cache
def encoder(name: str, by: str) -> Encoder:
    return Encoder(name, by)


def with_end(flat: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text's ids, and the new numbers of ids."""
    return np.insert(flat, np.cumsum(n), end), n + 1
