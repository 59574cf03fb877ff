"""SentencePiece merge-type encoding with seeded merge dropout, and decoding.

A word (white space as the mark before it) starts as characters; an agenda holds its neighbouring
pairs that form a piece, best score first, leftmost on ties. A candidate that comes up is skipped for
good with the dropout share's probability; otherwise it is merged and its new neighbours join the
agenda. Share 0 gives the library's own pieces. Each occurrence of a word draws for each of its
candidates: the gaps between its skipped candidates are geometric numbers, by keyed hash of seed, doc_id and
the word's place in the text. What a word becomes follows from the numbers of the candidates that are
skipped, so results are kept by word and skips and reused; the same seed always gives the same ids.

Characters that no piece covers, and marks in the text itself, are spelt in bytes, so every text decodes to itself. Null text counts
as empty; repeated rows get equal ids, a null doc_id hashes as -1. Other columns are ignored. An empty table gives an empty result.
"""
from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import lots

MODEL = "piece_bpe_32k.model"
MARK = "▁"
OWN_MARK = "\udc81"  # stands for a mark that is in the text itself; no text that Spark holds has it
DROPOUT, SEED = 0.1, 1
CACHED = 350_000  # words and skips of each of the two generations of a cache


@functools.cache
def library():  # noqa: ANN201
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


class Pieces:
    """The model's pieces, their scores and byte pieces."""

    def __init__(self) -> None:
        sp = library()
        self.n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(self.n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(self.n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.raw = [self.text[i].replace(MARK, " ").encode() if i not in self.of_byte else bytes([self.of_byte[i]]) for i in range(self.n)]

    def spell(self, piece: str) -> list[int]:
        return [self.id[piece]] if piece in self.id else [self.byte[b] for b in piece.replace(OWN_MARK, MARK).encode("utf-8", "surrogatepass")]


@functools.cache
def pieces() -> Pieces:
    return Pieces()


def _mixed(x):  # noqa: ANN001, ANN202
    """64 mixed bits of a Python integer or an array of unsigned ones."""
    of, mask = (np.uint64, None) if isinstance(x, np.ndarray) else (int, (1 << 64) - 1)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 1)):
        x = (x ^ (x >> of(shift))) * of(factor)
        x = x if mask is None else x & mask
    return x


def _key(word: str, seed: int, variant: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{variant}:{word}".encode("utf-8", "surrogatepass"))


PLACE = 0x9E3779B97F4A7C15
NEVER = 1 << 40  # a gap that no word reaches


def _gaps(keys: np.ndarray, draw: int, dropout: float) -> np.ndarray:
    """How many candidates each key merges before it skips one: its draw-th geometric number."""
    u = (_mixed(keys + np.uint64(PLACE * (draw + 1) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    if dropout >= 1:
        return np.zeros(len(keys), np.int64)
    return np.minimum(np.log1p(-u) / math.log1p(-dropout), NEVER).astype(np.int64)


def encode_word(word: str, dropout: float = 0.0, seed: int = 0, variant: int = 0) -> tuple[list[int], int]:
    """ids of a word and how many candidates were skipped, by the draws of one key."""
    return _by_heap(word, dropout, _key(word, seed, variant))


def _by_heap(word: str, dropout: float, key: int) -> tuple[list[int], int]:
    """encode_word with the agenda in a heap."""
    p = pieces()
    score = p.score
    sym = list(word)
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(-score[both], i, sym[i], sym[i + 1]) for i in range(n - 1) if (both := sym[i] + sym[i + 1]) in score]
    heapq.heapify(agenda)
    keys, skipped = np.array([key], np.uint64), 0
    left = int(_gaps(keys, 0, dropout)[0]) if dropout else NEVER  # candidates until the next that is skipped
    while agenda:
        _, i, a, b = heapq.heappop(agenda)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b or not a:
            continue
        if dropout and not left:
            skipped += 1
            left = int(_gaps(keys, skipped, dropout)[0])
            continue
        left -= 1
        sym[i], sym[j] = a + b, ""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (both := sym[k] + sym[after[k]]) in score:
                heapq.heappush(agenda, (-score[both], k, sym[k], sym[after[k]]))
    out: list[int] = []
    for s in sym:
        if s:
            out += p.spell(s)
    return out, skipped


LONG = 48  # words of more characters go to heaps, which grow better with length, and are not kept
LANES = 4096
NONE = np.int32(2**31 - 1)
WIDE = 3 * LONG // 8  # bytes of a word's skips
ALL = (1 << 8 * WIDE) - 1


class Merges:
    """Symbols (pieces, and characters inside pieces) by number, and which neighbours merge: rank of the piece they form and its number."""

    def __init__(self) -> None:
        p = pieces()
        chars = {c for t in p.id for c in t}
        self.names = [*p.id, *sorted(chars - p.id.keys())]
        self.number = {t: k for k, t in enumerate(self.names)}
        self.single = np.array([*(p.id.get(t, -1) for t in self.names), -1], np.int32)  # -1: spelt in bytes; the last: a character in no piece
        self.of_char = np.full(max(map(ord, chars)) + 1, len(self.names), np.int32)
        for c in chars | {t for t in self.names if len(t) == 1}:
            self.of_char[ord(c)] = self.number[c]
        place = {s: k for k, s in enumerate(sorted({-s for s in p.score.values()}))}
        found = sorted([((1 << 40), 0, 0), *((a * 65536 + b, place[-p.score[t]], self.number[t]) for t in p.id for k in range(1, len(t)) if (a := self.number.get(t[:k])) is not None and (b := self.number.get(t[k:])) is not None)])  # the last is above all keys
        self.key, self.rank, self.into = (np.array(x, d) for x, d in zip(zip(*found, strict=True), (np.int64, np.int32, np.int32), strict=True))

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where nothing is formed) and number of the piece that each pair forms."""
        key = a.astype(np.int64) * 65536 + b
        at = self.key.searchsorted(key)
        return np.where(self.key.take(at) == key, self.rank.take(at), NONE), self.into.take(at)


@functools.cache
def merges() -> Merges:
    return Merges()


def encode_words(words: list[tuple[str, int]], dropout: float, seed: int) -> list[tuple[bytes, int]]:
    """encode_word for many (word, variant) pairs."""
    keys = np.array([_key(w, seed, v) for w, v in words], np.uint64)
    skips: list[int] = [0] * len(words)
    short = np.array([k for k, (w, _) in enumerate(words) if len(w) <= LONG], np.int64) if dropout else np.zeros(0, np.int64)
    at, draw = _gaps(keys[short], 0, dropout) if dropout else short, 0
    while len(short):
        inside = at < 3 * LONG
        short, at, draw = short[inside], at[inside], draw + 1
        for k, x in zip(short.tolist(), at.tolist(), strict=True):
            skips[k] |= 1 << x
        at = at + 1 + _gaps(keys[short], draw, dropout)
    long = [k for k, (w, _) in enumerate(words) if len(w) > LONG]
    out = {k: _packed(_by_heap(words[k][0], dropout, int(keys[k]))) for k in long}
    rest = [k for k in range(len(words)) if k not in out]
    out |= {k: got[:2] for k, got in zip(rest, with_skips([(words[k][0], skips[k]) for k in rest]), strict=True)}
    return [out[k] for k in range(len(words))]


def _packed(got: tuple[list[int], int]) -> tuple[bytes, int]:
    return np.array(got[0], np.uint16).tobytes(), got[1]


def with_skips(words: list[tuple[str, int]]) -> list[tuple[bytes, int, int]]:
    """ids, skipped and all candidates of words of LONG characters or fewer. Bit c of the number beside a word tells to skip its candidate c; the agendas of up to LANES words of similar length advance in step, one candidate of each a round."""
    skips = np.zeros((len(words), 8 * WIDE), bool)
    some = [k for k, (_, x) in enumerate(words) if x]
    if some:
        skips[some] = np.unpackbits(np.frombuffer(b"".join([(words[k][1] & ALL).to_bytes(WIDE, "little") for k in some]), np.uint8).reshape(-1, WIDE), axis=1, bitorder="little")
    return run_agendas([w for w, _ in words], skips)


def run_agendas(words: list[str], skips: np.ndarray) -> list[tuple[bytes, int, int]]:
    """with_skips, the skips of each word as a row of flags."""
    out: list[tuple[bytes, int, int]] = [(b"", 0, 0)] * len(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for k in range(0, len(order), LANES):
        some = order[k : k + LANES]
        width = max(1, 3 * int(size[some[-1]]))  # a word of n characters has fewer than 3 * n candidates
        for at, got in zip(some.tolist(), _in_step([words[i] for i in some.tolist()], skips[some, :width]), strict=True):
            out[at] = got
    return out


def _in_step(words: list[str], skip: np.ndarray) -> list[tuple[bytes, int, int]]:
    m = merges()
    n, most = len(words), max(len(w) for w in words)
    unknown, end = len(m.names), most
    sym = np.full((n, most + 1), -1, np.int32)  # -1: merged away, or past the word's end
    ends = np.fromiter(map(len, words), np.int64, n)
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym[np.arange(most + 1) < ends[:, None]] = np.where(code < len(m.of_char), m.of_char[np.minimum(code, len(m.of_char) - 1)], unknown)
    there = np.arange(1, most + 1) < ends[:, None]
    rank, into = np.full((n, most + 1), NONE, np.int32), np.zeros((n, most + 1), np.int32)
    rank[:, :-1][there], into[:, :-1][there] = m.find(sym[:, :-1][there], sym[:, 1:][there])
    after = np.full((n, most + 1), end)
    after[:, :-1] = np.where(there, np.arange(1, most + 1), end)
    before = np.tile(np.arange(-1, most), (n, 1))
    skipped, met, rows, turn = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), 0
    dropping = bool(skip.any())
    flat_sym, flat_rank, flat_into, flat_after, flat_before = (x.ravel() for x in (sym, rank, into, after, before))
    while len(rows):
        i = rank.take(rows, axis=0).argmin(axis=1)
        at = rows * (most + 1)  # where the row begins in the flat views
        alive = flat_rank.take(at + i) != NONE
        rows = r = rows[alive]
        i, at = i[alive], at[alive]
        x = at + i
        j = flat_after.take(x)
        met[r] += 1
        if dropping:
            merged = ~skip[r, turn]
            gone = ~merged
            flat_rank[x[gone]] = NONE
            skipped[r[gone]] += 1
            i, j, at, x = i[merged], j[merged], at[merged], x[merged]
        turn += 1
        new = flat_into.take(x)
        then, left = flat_after.take(at + j), flat_before.take(x)
        flat_sym[x], flat_sym[at + j] = new, -1
        flat_rank[x] = flat_rank[at + j] = NONE
        flat_after[x], flat_before[at + then] = then, i
        ok = left >= 0
        q = (at + left)[ok]
        flat_rank[q], flat_into[q] = m.find(flat_sym.take(q), new[ok])
        ok = then < end
        q = x[ok]
        flat_rank[q], flat_into[q] = m.find(new[ok], flat_sym.take((at + then)[ok]))
    live = sym >= 0
    flat, counts = m.single[sym[live]], live.sum(axis=1)
    begin = np.concatenate([[0], np.cumsum(counts)])
    odd = np.unique(np.searchsorted(begin, np.flatnonzero(flat < 0), "right") - 1)
    raw, cuts = flat.astype(np.uint16).tobytes(), (2 * begin).tolist()
    out = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    for row in odd.tolist():  # a symbol that is spelt in bytes
        w = words[row]
        ids = [i for c, x in enumerate(sym[row].tolist()) if x >= 0 for i in pieces().spell(m.names[x] if x < unknown else w[c])]
        out[row] = np.array(ids, np.uint16).tobytes()
    return list(zip(out, skipped.tolist(), met.tolist(), strict=True))


#: A word begins at a mark that follows another character, and ends at a newline: no piece has such a mark or a newline inside.
WORDS = re.compile("\n|▁+[^▁\n]*|[^▁\n]+")
#: Texts with these, or a blank or newline at an end, are cut by WORDS itself.
PECULIAR, BLANK = ("  ", " \n", "\n ", "\n\n", MARK, "\x00"), (" ", "\n")


class Encoder:
    def __init__(self, dropout: float, seed: int, cached: int = CACHED):
        self.dropout, self.seed, self.cached = dropout, seed, cached
        self.cache: dict[tuple[str, int], tuple[bytes, int, int]] = {}
        self.old: dict[tuple[str, int], tuple[bytes, int, int]] = {}
        self.mark = {c: _packed((pieces().spell(c), 0))[0] for c in ".,"}
        self.apart = not any(a.isalpha() and b in ".," for t in pieces().id for a, b in zip(t, t[1:]))

    def _learn(self, keys: list[tuple[str, int]]) -> list[tuple[bytes, int, int]]:
        """with_skips by the cache."""
        if len(self.cache) > self.cached:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        found = list(map(cache.get, keys))
        new: dict[tuple[str, int], None] = {}
        unmet = [k for k, x in enumerate(found) if x is None]
        for k in unmet:
            if (got := old.get(keys[k])) is not None:
                cache[keys[k]] = got
            else:
                new[keys[k]] = None
        cache.update(zip(new, with_skips(list(new)), strict=True))
        for k in unmet:
            found[k] = cache[keys[k]]
        return found

    def _bare(self, words: list[str]) -> tuple[list[str], list[str]]:
        """Words without the comma or full stop that ends them after a letter, and that mark; it is a word of its own where no piece joins the two."""
        if not self.apart:
            return words, [""] * len(words)
        tails = [w[-1] if w[-1] in ".," and w[-2:-1].isalpha() else "" for w in words]
        return [w[:-1] if t else w for w, t in zip(words, tails, strict=True)], tails

    def _keys(self, counts: np.ndarray, doc_ids: list[int | None]) -> np.ndarray:
        """A key for each occurrence of a word: of the seed, its document and its place there."""
        of = np.array([xxhash.xxh64_intdigest(f"{self.seed}:{-1 if d is None else d}") for d in doc_ids], np.uint64)
        n = np.array(counts, np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return _mixed(np.repeat(of, n) + np.uint64(PLACE) * place.astype(np.uint64))

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The number of words of each text, the distinct words, and which of them each word is."""
        texts = [t or "" for t in texts]
        plain = [not (any(x in t for x in PECULIAR) or t[:1] in BLANK or t[-1:] in BLANK) for t in texts]
        # Single blanks and newlines apart, with no mark in the text: Arrow cuts and numbers the words.
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(pa.array([t if p and t else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()), "\n", "\x00\n\x00"), " ", "\x00" + MARK), "\x00")
        counts, flat, first = np.diff(lists.offsets.to_numpy()), lists.flatten(), lists.offsets.to_numpy()[:-1]
        coded = pc.dictionary_encode(flat)
        node, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        lead = np.flatnonzero(counts * np.array([bool(t) for t in texts]) * np.array(plain))
        if len(lead):  # the first word of a text follows the blank that is put before it
            words = [MARK + distinct[k] for k in node[first[lead]].tolist()]
            number = {w: k for k, w in enumerate(distinct)}
            node[first[lead]] = [number.setdefault(w, len(number)) for w in words]
            distinct = list(number)
        nothing = np.array([not w for w in distinct])
        keep = ~nothing[node]
        owner = np.repeat(np.arange(len(texts)), counts)[keep]
        node, counts = node[keep], np.bincount(owner, minlength=len(texts))
        odd = [k for k, p in enumerate(plain) if not p]
        if odd:
            number = {w: k for k, w in enumerate(distinct)}
            put, parts = number.setdefault, np.split(node, np.cumsum(counts)[:-1])
            for k in odd:
                parts[k] = np.array([put(w, len(number)) for w in WORDS.findall((" " + texts[k]).replace(MARK, OWN_MARK).replace(" ", MARK))], np.int64)
            node, counts, distinct = np.concatenate(parts), np.array([len(x) for x in parts]), list(number)
        return counts, distinct, node

    def encode(self, texts: list[str | None], doc_ids: list[int | None]) -> list[tuple[np.ndarray, int]]:
        """Of each text its ids and the number of skipped candidates."""
        if not texts:
            return []
        counts, distinct, node = self._words(texts)
        times, size = np.bincount(node, minlength=len(distinct)), np.fromiter(map(len, distinct), np.int64, len(distinct))
        keys = self._keys(counts, doc_ids)
        got: list[tuple] = [(b"", 0, 0)] * len(distinct)
        once = np.flatnonzero((times[node] == 1) & (size[node] <= LONG))
        alone = node[once].tolist()
        for k, x in zip(alone, self._alone([distinct[k] for k in alone], keys[once]), strict=True):
            got[k] = x
        self._shared(node, distinct, times, size, keys, got)
        sizes = np.fromiter((len(x[0]) for x in got), np.int64, len(got)) >> 1
        starts, ids, skipped = np.cumsum(sizes) - sizes, np.frombuffer(b"".join([x[0] for x in got]), np.uint16), np.fromiter((x[1] for x in got), np.int64, len(got))
        many = sizes[node]
        ends = np.cumsum(many)
        flat = ids[np.repeat(starts[node] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate(([0], np.cumsum(counts)))
        at, lost = np.concatenate(([0], ends))[cuts], np.concatenate(([0], np.cumsum(skipped[node])))[cuts]
        return [(flat[a:b], n) for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), np.diff(lost).tolist(), strict=True)]

    def _alone(self, words: list[str], keys: np.ndarray) -> list[tuple[bytes, int, int]]:
        """Words that a lot holds once: every skip that a key may draw is drawn at first, so one agenda is enough."""
        bare, tails = self._bare(words)
        skips = np.zeros((len(words), 8 * WIDE), bool)
        if self.dropout:
            most, row, draw = 3 * np.fromiter(map(len, bare), np.int64, len(bare)), np.arange(len(words)), 0
            at = _gaps(keys, 0, self.dropout)
            while len(row):
                inside = at < most[row]
                row, at, draw = row[inside], at[inside], draw + 1
                skips[row, at] = True
                at = at + 1 + _gaps(keys[row], draw, self.dropout)
        return [(x[0] + self.mark[t], x[1], x[2]) if t else x for x, t in zip(run_agendas(bare, skips), tails, strict=True)]

    def _shared(self, node: np.ndarray, distinct: list[str], times: np.ndarray, size: np.ndarray, keys: np.ndarray, got: list[tuple]) -> None:
        """Words that a lot holds more than once, and long ones: results are kept by word and skips, one more skip a round. Changes node and got."""
        nodes: dict[int, tuple[str, int, str]] = {}  # a word, the skips so far, and the mark behind it
        often = np.flatnonzero((times > 1) & (size <= LONG)).tolist()
        bare, tails = self._bare([distinct[k] for k in often])
        for k, w, t, x in zip(often, bare, tails, self._learn([(w, 0) for w in bare]), strict=True):
            got[k], nodes[k] = (x[0] + self.mark[t], x[1], x[2]) if t else x, (w, 0, t)
        for k in np.flatnonzero(size[node] > LONG).tolist():
            got.append(_packed(_by_heap(distinct[node[k]], self.dropout, int(keys[k]))))
            node[k] = len(got) - 1
        if not self.dropout:
            return
        candidates = np.zeros(len(got), np.int64)
        candidates[often] = [got[k][2] for k in often]
        going, draw = np.flatnonzero(candidates[node] > 0), 0
        at = _gaps(keys[going], 0, self.dropout)
        while True:
            skip = at < candidates[node[going]]
            going, at, draw = going[skip], at[skip], draw + 1
            if not len(going):
                return
            step, back = np.unique(node[going] << 8 | at, return_inverse=True)
            new = [(n[0], n[1] | 1 << c, n[2]) for n, c in zip(map(nodes.__getitem__, (step >> 8).tolist()), (step & 255).tolist(), strict=True)]
            node[going] = len(got) + back
            nodes.update(zip(range(len(got), len(got) + len(new)), new, strict=True))
            found = self._learn([n[:2] for n in new])
            got += [(x[0] + self.mark[n[2]], x[1], x[2]) if n[2] else x for x, n in zip(found, new, strict=True)]
            candidates = np.append(candidates, [x[2] for x in found])
            at = at + 1 + _gaps(keys[going], draw, self.dropout)


@functools.cache
def encoder(dropout: float, seed: int) -> Encoder:
    return Encoder(dropout, seed)


def decode(ids: np.ndarray) -> str:
    """The text of ids: pieces' bytes joined, the space put before every text taken off."""
    raw = pieces().raw
    return b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")[1:]


def segment(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, ids (binary, 16-bit little-endian), n_tokens, n_skipped, ids_crc32 (as 32-bit little-endian), lossless (they decode to the text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(dropout, seed)
        for b in lots(batches):
            docs, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            found = enc.encode(texts, docs)
            crc = [zlib.crc32(ids.astype("<u4")) for ids, _ in found]
            same = [decode(ids) == (text or "") for text, (ids, _) in zip(texts, found, strict=True)]
            columns = [b["doc_id"], pa.array([ids.tobytes() for ids, _ in found], pa.binary()), pa.array([len(ids) for ids, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "n_skipped", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, ids binary, n_tokens long, n_skipped long, ids_crc32 long, lossless boolean")
