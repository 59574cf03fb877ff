"""Adaptive context-mixing range coder for blocks of token ids.

A block's ids are cut into lanes (runs of equal length) that are coded side by side, so each step of the
coder is a handful of array operations; every lane has its own range coder, all share the block's
model, and nothing carries over to another block.

For each id: is it the id that last followed its two predecessors (order 2)? If not, is it the one that last followed its
predecessor (order 1)? If not, it is coded from the block's counts (order 0). The
probability of each yes mixes the confidence of the orders 2 and 1 in the logistic domain with
weights that learn; confidences have 64 levels, so a mix is a table that is made anew, with the sums of the
counts, at the steps of REFRESH. All arithmetic is on integers, so the decoder repeats it exactly.

A lane's state is a range of 33 to 48 bits and the low end of its interval; when the range falls under 32 bits, 16 of the
interval's bits are settled but for a carry, which is kept in the word's 17th bit and resolved when the block ends.
"""
from __future__ import annotations

import functools
import math
import struct
import zlib

import numpy as np

MAGIC, HEAD = b"PID2", "<4sIIIIIIII"
LANES, STEPS = 8192, 128
SLOTS = 18  # bits of the order-2 table
ADD = 2  # of an id's count, each time it is seen
REFRESH = frozenset([0, 1, 2, 3, 5, 8, 12, 16, 24, 32])  # and each 16th step
LISTED = 1 << 23  # largest total that is listed place by place for decoding
LOW32, WORD = np.uint64((1 << 32) - 1), np.uint64(16)
LEAST, WIDE, SCALE = np.uint64(1 << 32), np.uint64(32), np.uint64(16)


@functools.cache
def _stretch() -> np.ndarray:
    """The logit of each of 64 levels of confidence; scale 256."""
    return np.array([round(256 * math.log((i + 0.5) / (63.5 - i))) for i in range(64)], np.int64)


@functools.cache
def _squash() -> np.ndarray:
    """Probabilities in 1..65535 of logits -2047..2047."""
    return np.array([min(65535 - 16, max(16, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.uint32)


class _Model:
    def __init__(self, vocab: int, lanes: int):
        self.vocab, self.count = vocab, np.ones(vocab, np.int64)
        # An entry holds the id that came last (low 16 bits) and how sure that is to repeat (high 16).
        self.table1, self.table2 = np.full(vocab, 1 << 30, np.uint32), np.full(1 << SLOTS, 1 << 30, np.uint32)
        # Weights of orders 2 and 1: both foretell the same id; order 2 with another foretold by order 1; order 1 after a miss.
        self.weights = np.array([[30000, 30000], [45000, 8000], [0, 45000]], np.int64)
        self.error = [np.zeros(4096), np.zeros(4096), np.zeros(4096)]
        self.p1, self.p2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.seen: list[np.ndarray] = []

    def refresh(self, listed: bool) -> None:
        s = _stretch()
        for k, e in enumerate(self.error):
            e = e.reshape(64, 64)
            n = max(1, sum(len(x) for x in self.seen))
            # Sums of whole numbers under 2**53: exact in any order.
            up = np.array([int((e.sum(axis=1) * s).sum()), int((e.sum(axis=0) * s).sum())])
            self.weights[k] += up * 3 // (n << 8)
            e[:] = 0
        for x in self.seen:
            self.count += ADD * np.bincount(x, minlength=self.vocab)
        self.seen = []
        self.cum = np.cumsum(self.count)
        self.total = int(self.cum[-1])
        self.first = self.cum - self.count
        self.mixed = np.concatenate([_squash()[np.clip((w[0] * s[:, None] + w[1] * s[None, :]).ravel() >> 16, -2047, 2047) + 2047] for w in self.weights]).astype(np.uint64)
        self.listing = np.repeat(np.arange(self.vocab, dtype=np.uint16), self.count) if listed and self.vocab <= 65536 and self.total <= LISTED else None

    def foretell(self, k: int) -> None:
        """guess2, guess1, whether they are the same, and the probability of guess2, for the first k lanes."""
        p1 = self.p1[:k]
        self.slot = ((p1 * np.uint32(0x9E3779B1) + self.p2[:k] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOTS)).astype(np.intp)
        self.at1 = p1.astype(np.intp)
        self.e2, self.e1 = self.table2.take(self.slot), self.table1.take(self.at1)
        self.guess2, self.guess1 = self.e2 & np.uint32(0xFFFF), self.e1 & np.uint32(0xFFFF)
        self.same = self.guess1 == self.guess2
        self.level = ((self.e2 >> np.uint32(26) << np.uint32(6)) | self.e1 >> np.uint32(26)).astype(np.intp)
        self.mix_a = self.level + np.where(self.same, 0, 4096)
        self.yes_a = self.mixed.take(self.mix_a)

    def second(self, lanes: np.ndarray) -> np.ndarray:
        """The probability of guess1 in lanes that missed a guess2 that differs."""
        self.level_b = self.level[lanes]
        self.yes_b = self.mixed.take(self.level_b + 8192)
        return self.yes_b

    def place(self, where: np.ndarray) -> np.ndarray:
        """The id that has the place among all counts."""
        return self.listing.take(where) if self.listing is not None else np.searchsorted(self.cum, where, "right").astype(np.uint32)

    def learn(self, ids: np.ndarray, hit_a: np.ndarray, hit_b: np.ndarray) -> None:
        k = len(ids)
        errors = np.bincount(self.mix_a, (hit_a.astype(np.int64) << 16) - self.yes_a.astype(np.int64), 8192)
        self.error[0] += errors[:4096]
        self.error[1] += errors[4096:]
        if len(hit_b):
            self.error[2] += np.bincount(self.level_b, (hit_b.astype(np.int64) << 16) - self.yes_b.astype(np.int64), 4096)
        for table, at, entry, right, rate in ((self.table2, self.slot, self.e2, hit_a, 3), (self.table1, self.at1, self.e1, self.guess1 == ids, 4)):
            sure = (entry >> np.uint32(16)).astype(np.int32)
            sure += (right * np.int32(65535) - sure) >> rate
            table[at] = sure.astype(np.uint32) << np.uint32(16) | ids
        self.seen.append(ids.astype(np.int32))
        self.p2[:k], self.p1[:k] = self.p1[:k], ids


def _shape(n: int) -> tuple[int, int]:
    """lanes, steps"""
    steps = max(1, -(-n // LANES), min(n, STEPS))
    return max(1, -(-n // steps)), steps


def _active(n: int, steps: int, t: int) -> int:
    return (n - t + steps - 1) // steps


def _due(t: int) -> bool:
    return t in REFRESH or t % 16 == 0


def encode_ids(ids: np.ndarray, vocab: int) -> bytes:
    n = len(ids)
    lanes, steps = _shape(n)
    model, low, size = _Model(vocab, lanes), np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    out, used = np.zeros((lanes, 4 * steps + 4), np.uint32), np.zeros(lanes, np.int64)
    flat, row = out.ravel(), np.arange(lanes) * out.shape[1]
    grid = np.zeros(lanes * steps, np.uint32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)

    def settle(at: np.ndarray) -> None:
        """Words of the given lanes, whose range is too small, go out."""
        while len(at):
            lo = low[at]
            flat[row[at] + used[at]] = lo >> WIDE
            used[at] += 1
            low[at] = (lo & LOW32) << WORD
            r = size[at] << WORD
            size[at] = r
            at = at[r < LEAST]

    for t in range(steps):
        k = _active(n, steps, t)
        x, lo, r = grid[t, :k], low[:k], size[:k]
        if _due(t):
            model.refresh(listed=False)
        model.foretell(k)
        hit = model.guess2 == x
        part = (r >> SCALE) * model.yes_a
        lo += part * ~hit
        r[:] = np.where(hit, part, r - part)
        b = np.flatnonzero(~(hit | model.same))
        yes_b = model.second(b)
        hit_b = model.guess1[b] == x[b]
        rb = r[b]
        part = (rb >> SCALE) * yes_b
        lo[b] += part * ~hit_b
        r[b] = np.where(hit_b, part, rb - part)
        rest = ~hit
        rest[b[hit_b]] = False
        c = np.flatnonzero(rest)
        settle(c[r[c] < LEAST])
        unit, xc = r[c] // np.uint64(model.total), x[c]
        lo[c] += unit * model.first.take(xc).astype(np.uint64)
        r[c] = unit * model.count.take(xc).astype(np.uint64)
        model.learn(x, hit, hit_b)
        settle(np.flatnonzero(r < LEAST))
    for _ in range(3):
        flat[row + used] = low >> WIDE
        used += 1
        low = (low & LOW32) << WORD
    for k in range(out.shape[1] - 1, 0, -1):  # carries, last word first
        out[:, k - 1] += out[:, k] >> np.uint32(16)
    words = out.astype("<u2")[np.arange(out.shape[1])[None, :] < used[:, None]].tobytes()
    sizes = zlib.compress(used.astype("<u4").tobytes(), 6)
    return struct.pack("<II", n, len(sizes)) + sizes + words


def decode_ids(data: bytes, vocab: int) -> np.ndarray:
    n, length = struct.unpack_from("<II", data)
    lanes, steps = _shape(n)
    used = np.frombuffer(zlib.decompress(data[8 : 8 + length]), "<u4").astype(np.int64)
    code = np.concatenate((np.frombuffer(data, "<u2", offset=8 + length), np.zeros(4, np.uint16))).astype(np.uint64)
    read = np.concatenate(([0], np.cumsum(used)[:-1]))
    model, size, value = _Model(vocab, lanes), np.full(lanes, 1 << 48, np.uint64), np.zeros(lanes, np.uint64)  # value: the code less the low end
    for _ in range(3):
        value = (value << WORD) | code[read]
        read += 1
    grid = np.zeros((steps, lanes), np.uint32)

    def settle(at: np.ndarray) -> None:
        while len(at):
            where = read[at]
            value[at] = (value[at] << WORD) | code.take(where, mode="clip")
            read[at] = where + 1
            r = size[at] << WORD
            size[at] = r
            at = at[r < LEAST]

    for t in range(steps):
        k = _active(n, steps, t)
        r, v, x = size[:k], value[:k], grid[t, :k]
        if _due(t):
            model.refresh(listed=True)
        model.foretell(k)
        part = (r >> SCALE) * model.yes_a
        hit = v < part
        v -= part * ~hit
        r[:] = np.where(hit, part, r - part)
        x[:] = model.guess2  # right where hit
        b = np.flatnonzero(~(hit | model.same))
        rb, vb = r[b], v[b]
        part = (rb >> SCALE) * model.second(b)
        hit_b = vb < part
        v[b] = vb - part * ~hit_b
        r[b] = np.where(hit_b, part, rb - part)
        right = b[hit_b]
        x[right] = model.guess1[right]
        rest = ~hit
        rest[right] = False
        c = np.flatnonzero(rest)
        settle(c[r[c] < LEAST])
        unit, vc = r[c] // np.uint64(model.total), v[c]
        xc = model.place(np.minimum(vc // unit, np.uint64(model.total - 1)).astype(np.int64))
        x[c] = xc
        v[c] = vc - unit * model.first.take(xc).astype(np.uint64)
        r[c] = unit * model.count.take(xc).astype(np.uint64)
        model.learn(x, hit, hit_b)
        settle(np.flatnonzero(r < LEAST))
    return grid.T.ravel()[:n]


def pack_block(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    """Header, documents (id, null or not, length), ids; checksums of both parts and of the ids."""
    docs = zlib.compress(np.diff(doc_ids.astype("<i8"), prepend=np.int64(0)).tobytes() + nulls.astype(np.uint8).tobytes() + lengths.astype("<u4").tobytes(), 6)
    body = encode_ids(ids, vocab)
    head = struct.pack(HEAD, MAGIC, vocab, len(doc_ids), len(ids), len(docs), len(body), zlib.crc32(docs), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + docs + body


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, nulls, lengths, ids; ValueError if a checksum fails."""
    magic, vocab, n, total, size, length, docs_crc, body_crc, ids_crc = struct.unpack_from(HEAD, data)
    at = struct.calcsize(HEAD)
    docs, body = data[at : at + size], data[at + size : at + size + length]
    if magic != MAGIC or zlib.crc32(docs) != docs_crc or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block of token ids")
    raw = zlib.decompress(docs)
    ids = decode_ids(body, vocab)
    if len(ids) != total or zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("block of token ids does not decode to what was written")
    return np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, np.uint8, n, 8 * n) > 0, np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64), ids
