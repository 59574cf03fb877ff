"""Main text of pages by a bidirectional LSTM over their blocks; numpy only.

Each block (html_blocks) is a vector of its hashed tag path (names, classes, ids, roles), hashed words
and a few numbers; the network reads the whole page both ways and labels every block as article or
not. It is trained once in a process on TRAIN_PAGES pages made up from a fixed seed, in many layouts, whose labels are
known as they are made; in about half of them a share of the names is unknown or gone. No row of the input is used. Texts are never shortened.

Null html has no blocks: empty text. Repeated rows get equal texts. A null page_id or url stays null. A very long page is scored alone,
in time and memory by its number of blocks. Other columns are ignored. An empty table gives an empty result.
"""
from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks

PATHS, WORDS, NUMBERS = 192, 32, 5
HIDDEN = 16
TRAIN_PAGES, EPOCHS, BATCH = 1400, 10, 16
CELLS = 16_384  # blocks, padding included, that are scored together; a longer page is scored alone

CONTENT = [["article"], ["main", "article"], ["div", ".content", "article"], ["div", ".main", ".content"], ["div", ".post", ".body"], ["div", ".entry", ".content"], ["section", ".article", ".text"], ["main"], ["div", ".story"], ["div", ".wrap", "article", ".post"], ["div", ".container", "main", "div", ".article", ".body"], ["div", ".body", ".content"], ["div"], ["table", "tbody", "tr", "td"], ["table", "tr", "td", ".content"], ["div", ".story", ".text"], []]
ASIDE = [["nav", "ul"], ["header"], ["footer"], ["aside"], ["div", ".sidebar"], ["div", ".ad"], ["div", ".ads"], ["div", ".advert"], ["div", ".banner"], ["div", ".sponsored"], ["div", ".promo"], ["div", ".cookie", ".notice"], ["div", ".cookies"], ["div", ".consent"], ["div", ".alert"], ["div", ".notice"], ["form"], ["form", ".search"], ["div", ".comments"], ["section", ".comments"], ["div", ".comment"], ["ol", ".commentlist"], ["div", ".menu"], ["ul", ".nav"], ["div", ".navigation"], ["div", ".breadcrumbs"], ["div", ".share"], ["div", ".social"], ["div", ".related"], ["div", ".newsletter"], ["div", ".footer"], ["div", ".header"], ["div", ".widget"], ["div", ".login"], ["div", ".popup"], ["div", ".toolbar"], ["div", ".copyright"], ["table", ".menu"], ["div", ".disclaimer"], ["div", ".subscribe"], ["section", ".reader", ".comments"], ["div", ".disqus", ".thread"], ["div", ".thread"], ["div", ".replies"], ["section", ".discussion"], ["div", ".right", ".col"], ["div", ".gdpr", ".overlay"], ["div", ".modal"], ["td", ".nav"], ["table", "tr", "td", ".menu"]]
IN_CONTENT = [["h1"], ["h2"], ["h3"], ["p"], ["p"], ["p"], ["p"], ["p"], ["ul", "li"], ["ol", "li"], ["blockquote", "p"], ["pre"], ["table", "tbody", "tr", "td"], ["p", "b"], ["div"], ["section", "p"], ["figure", "figcaption"], ["dl", "dd"], []]
IN_ASIDE = [["p"], ["li", "a"], ["ul", "li", "a"], ["ul", "li"], ["div"], ["span"], ["label"], ["button"], ["h2"], ["h3"], ["a"], ["article", "p"], ["div", "p"], ["blockquote", "p"], []]


@functools.lru_cache(maxsize=200_000)
def _hash(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), PATHS + WORDS + NUMBERS), np.float32)
    for row, b in zip(out, page, strict=True):
        for x in b.path:
            row[_hash(x, PATHS)] = 1
        words = b.text.lower().split()
        share = np.bincount([_hash(w, WORDS) for w in words], minlength=WORDS)
        row[PATHS : PATHS + WORDS] = share / (2 * len(words))
        row[PATHS + WORDS :] = (min(np.log1p(len(words)) / 6, 2), b.linked, len(b.path) / 20, b.text[-1] in ".!?:;", 1)
    return out


def _renamed(rng: np.random.Generator, path: list[str], share: float) -> list[str]:
    """path with a share of its classes, ids and roles unknown or gone, so that words, links, lengths and neighbours must tell."""
    out = []
    for x in path:
        if not x.startswith(".") or rng.random() >= share:
            out.append(x)
        elif rng.random() < 0.6:
            out.append("." + "".join(map(chr, rng.integers(97, 123, int(rng.integers(1, 8))))))
    return out


def _made_page(rng: np.random.Generator, share: float = 0.0) -> tuple[list[Block], list[int]]:
    """A page and its labels; share of its names is unknown or gone."""
    root = ["html", "body"] + ([["div", ".page"], ["div", ".wrapper"], [".en"]][int(rng.integers(3))] if rng.random() < 0.3 else [])

    def say(n: int, sentence: bool) -> str:
        words = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9))))) for _ in range(max(1, n))]
        return " ".join(words) + ("." if sentence else "")

    brief = rng.random() < 0.07  # an article of short lines

    def some(prefix: list[str], label: int, n: int) -> list[tuple[Block, int]]:
        made = []
        for _ in range(n):
            end = (IN_CONTENT if label else IN_ASIDE)[int(rng.integers(len(IN_CONTENT if label else IN_ASIDE)))]
            long = rng.random() < ((0.3 if brief else 0.85) if label else 0.3)
            linked = float(not label and ("a" in end))
            made.append((Block((*prefix, *end), say(int(rng.integers(8, 60)) if long else int(rng.integers(1, 7)), long), linked), label))
        return made

    page = [(Block(("html", "head", "title"), say(6, False), 0.0), 0)] if rng.random() < 0.8 else []
    content = _renamed(rng, CONTENT[int(rng.integers(len(CONTENT)))], share)
    pick = lambda: _renamed(rng, ASIDE[int(rng.integers(len(ASIDE)))], share / 2)
    for _ in range(int(rng.integers(0, 5))):
        page += some(root + pick(), 0, int(rng.integers(1, 6)))
    for _ in range(int(rng.integers(1, 4))):
        page += some(root + content, 1, int(rng.integers(1, 9)))
        if rng.random() < 0.5:
            page += some(root + content + pick(), 0, int(rng.integers(1, 4)))
    for _ in range(int(rng.integers(0, 4))):
        page += some(root + pick(), 0, int(rng.integers(1, 6)))
    return [p[0] for p in page], [p[1] for p in page]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(z_in: np.ndarray, u: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states of one direction for (steps, pages, gates); trace takes what the backward pass needs."""
    steps, pages, _ = z_in.shape
    h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    states = np.empty((steps, pages, HIDDEN), np.float32)
    for t in range(steps):
        z = z_in[t] + h @ u
        g = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, a = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        new = f * c + i * a
        tanh = np.tanh(new)
        if trace is not None:
            trace.append((h, c, i, f, o, a, tanh))
        h, c = o * tanh, new
        states[t] = h
    return states


def _back(x: np.ndarray, u: np.ndarray, trace: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dz_all = np.empty((*d_states.shape[:2], 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros_like(d_states[0]), np.zeros_like(d_states[0])
    for t in range(len(trace) - 1, -1, -1):
        h, c, i, f, o, a, tanh = trace[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - tanh**2)
        dz = np.concatenate((dc * a * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - a**2)), axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh, dc = dz @ u.T, dc * f
    return np.tensordot(x, dz_all, ((0, 1), (0, 1))), du, dz_all.sum(axis=(0, 1))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, pages, inputs), the mask, and each page's order reversed (padding stays behind)."""
    n = np.array([len(p) for p in pages])
    steps = int(n.max())
    x = np.zeros((steps, len(pages), PATHS + WORDS + NUMBERS), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    t = np.arange(steps)[:, None]
    return x, t < n, np.where(t < n, n - 1 - t, t)


def _flip(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return np.take_along_axis(x, turn[:, :, None], axis=0)


def _head(weights: list[np.ndarray], ahead: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate((ahead, behind), axis=2)
    return _sigmoid(both @ weights[6] + weights[7])[:, :, 0], both


def _scores(weights: list[np.ndarray], pages: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
    """Scores of training pages, and what the backward pass needs."""
    x, mask, turn = _padded(pages)
    back, trace1, trace2 = _flip(x, turn), [], []
    ahead = _run(x @ weights[0] + weights[2], weights[1], trace1)
    behind = _run(back @ weights[3] + weights[5], weights[4], trace2)
    p, both = _head(weights, ahead, _flip(behind, turn))
    return p, (x, mask, turn, back, trace1, trace2, both)


def _score(weights: list[np.ndarray], pages: list[list[Block]]) -> np.ndarray:
    """Scores of pages. Their vectors exist only for some blocks at a time: a block leaves its gates' inputs behind."""
    n = np.array([len(p) for p in pages])
    steps = int(n.max())
    z = np.zeros((2, steps, len(pages), 4 * HIDDEN), np.float32)
    for k, page in enumerate(pages):
        for at in range(0, len(page), 2048):
            v = vectors(page[at : at + 2048])
            z[0, at : at + len(v), k] = v @ weights[0]
            z[1, at : at + len(v), k] = v @ weights[3]
    t = np.arange(steps)[:, None]
    turn = np.where(t < n, n - 1 - t, t)
    ahead = _run(z[0] + weights[2], weights[1])
    behind = _run(_flip(z[1], turn) + weights[5], weights[4])
    return _head(weights, ahead, _flip(behind, turn))[0]


@functools.cache
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 5) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    made = [_made_page(rng, float(min(1.0, max(0.0, 2 * rng.random() - 0.95)))) for _ in range(pages)]  # nearly half of the pages know all names
    xs, ys = [vectors(p) for p, _ in made], [np.array(y, np.float32) for _, y in made]
    n_in = PATHS + WORDS + NUMBERS
    shapes = [(n_in, 4 * HIDDEN), (HIDDEN, 4 * HIDDEN), (4 * HIDDEN,)] * 2 + [(2 * HIDDEN, 1), (1,)]
    weights = [(rng.standard_normal(s) * 0.15).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in shapes]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    order = np.argsort([len(x) for x in xs], kind="stable")
    for epoch in range(epochs):
        for k in rng.permutation(range(0, pages, BATCH)):
            some = order[k : k + BATCH]
            p, (x, mask, turn, back, trace1, trace2, both) = _scores(weights, [xs[i] for i in some])
            y = np.zeros_like(p)
            for c, i in enumerate(some):
                y[: len(ys[i]), c] = ys[i]
            d = ((p - y) * mask / mask.sum())[:, :, None].astype(np.float32)
            d_both = d @ weights[6].T
            grads = [*_back(x, weights[1], trace1, d_both[:, :, :HIDDEN]), *_back(back, weights[4], trace2, _flip(d_both[:, :, HIDDEN:], turn)), np.tensordot(both, d, ((0, 1), (0, 1))), d.sum(axis=(0, 1))]
            step += 1
            rate = 0.02 / (1 + epoch)
            for j, g in enumerate(grads):
                g = g + 1e-5 * weights[j]
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                weights[j] = weights[j] - rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    return [w.astype(np.float32) for w in weights]


def label_pages(weights: list[np.ndarray], pages: list[list[Block]], cells: int = CELLS) -> list[np.ndarray]:
    """For each page the blocks that belong to the article. Pages of like length are scored together, as many as keep their padded blocks under cells."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        some = [order[at]]
        while at + len(some) < len(order) and (len(some) + 1) * len(pages[order[at + len(some)]]) <= cells:
            some.append(order[at + len(some)])
        at += len(some)
        p = _score(weights, [pages[k] for k in some])
        for c, k in enumerate(some):
            out[k] = p[: len(pages[k]), c] > 0.5
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for each row."""
    weights = trained()

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k in range(0, len(p), 256):
                some = p.iloc[k : k + 256]
                found = [blocks(h) for h in some["html"]]
                texts = ["\n".join(b.text for b, keep in zip(page, of, strict=True) if keep) for page, of in zip(found, label_pages(weights, found), strict=True)]
                yield pd.DataFrame({"page_id": some["page_id"].astype("Int64").to_numpy(), "url": some["url"].to_numpy(), "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(x) for x in found]}).astype({"page_id": "Int64"})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(each, "page_id long, url string, text string, n_chars long, n_blocks long")
