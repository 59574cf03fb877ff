"""Boosted trees for candidate spans of personal data, fitted here on labelled candidates.

TRAIN_ROWS candidates, half real forms and half look-alikes (order numbers, serials, constants, numbers of impossible forms), are drawn from fixed seeds and put into windows of text: of up to
TRAIN_WINDOWS documents of the corpus where there are any, else of made-up words. Words that clue and words that counter stand in windows of both classes, as whole words; what tells is
whether one stands directly beside the span, and whether the span's own form holds (check digits, ranges of numbers, known ends of addresses). Another TRAIN_ROWS calibrate the thresholds: of the scores at which precision
among held-out candidates of the kind reaches PRECISION, the highest that keeps NEARLY all of the recall. Fitting takes seconds, once in a process for the same windows.
"""
from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np

TRAIN_ROWS = 3000
TRAIN_WINDOWS = 2000  # documents that give a window of 2 * CONTEXT characters each
TREES = 24
RATE = 0.4
PRECISION, NEARLY = 0.97, 0.985  # a threshold may cost 1.5 % of the recall that PRECISION allows
CONTEXT = 24
CLUES = ("tel", "phone", "call", "fax", "mail", "contact", "card", "visa", "ssn", "social", "iban", "account", "password", "pwd", "secret", "token", "key")
COUNTER = ("order", "item", "serial", "part", "isbn", "version", "build", "invoice", "ref", "const", "define", "checksum", "sha", "id")
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "uk", "us", "eu", "example")
GENERATOR_KINDS = ("phone", "email", "card", "ssn", "iban", "secret", "secret")
#: Patterns of the lower-case text beside a span, for both engines: a clue or counter as a whole word, a counter directly before or after.
NEAR_CLUE = f"(?:^|[^a-z])(?:{'|'.join(CLUES)})(?:[^a-z]|$)"
NEAR_COUNTER = f"(?:^|[^a-z])(?:{'|'.join(COUNTER)})(?:[^a-z]|$)"
COUNTER_BEFORE = f"(?:^|[^a-z])(?:{'|'.join(COUNTER)})(?: ?(?:no|nr|num|number|code))?[ .:#=-]*$"
COUNTER_AFTER = f"^[ .:#-]*(?:{'|'.join(COUNTER)})(?:[^a-z]|$)"
#: Forms that hold: of the last ten digits of a phone number; of a social security number; of the end of a spelt address.
PHONE_FORM, SSN_FORM = "[2-9][0-9]{9}$", "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
EMAIL_FORM = f"(?:{'|'.join(DOMAIN_ENDS)})$"


class Model(NamedTuple):
    start: float
    trees: list[tuple]
    thresholds: dict[str, float]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_rest(text: str) -> int:
    """The rest by 97 that a bank account number's letters and digits leave; 1 if it holds."""
    bare = text.replace(" ", "")
    out = 0
    for c in bare[4:] + bare[:4]:
        out = (out * 10 + ord(c) - 48 if c.isdigit() else out * 100 + ord(c) - 55) % 97
    return out


def _card(rng: np.random.Generator) -> str:
    d = "3456"[int(rng.integers(0, 4))] + "".join(map(str, rng.integers(0, 10, 14)))
    return d + next(c for c in "0123456789" if _luhn(d + c))


def _pick(rng: np.random.Generator, n: int, letters: str) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


UPPER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LOWER = UPPER.lower()


def _phone(rng: np.random.Generator, good: bool) -> str:
    area = _pick(rng, 1, "23456789" if good else "01") + _pick(rng, 2, DIGIT)
    three = _pick(rng, 3, DIGIT)
    four = _pick(rng, 4, DIGIT)
    return [f"({area}) {three}-{four}", f"{area}-{three}-{four}", f"{area}.{three}.{four}", f"{area} {three} {four}"][int(rng.integers(0, 4))]


def _ssn(rng: np.random.Generator, good: bool) -> str:
    while True:
        x = f"{_pick(rng, 3, DIGIT)}-{_pick(rng, 2, DIGIT)}-{_pick(rng, 4, DIGIT)}" if good or rng.random() < 0.3 else f"9{_pick(rng, 2, DIGIT)}-{_pick(rng, 2, DIGIT)}-{_pick(rng, 4, DIGIT)}"
        if bool(re.search(SSN_FORM, x)) == good:
            return x


def _iban(rng: np.random.Generator) -> str:
    country, body = _pick(rng, 2, UPPER), _pick(rng, 16, DIGIT)
    check = 98 - iban_rest(f"{country}00{body}")
    whole = f"{country}{check:02d}{body}"
    return whole if rng.random() < 0.5 else " ".join(whole[k : k + 4] for k in range(0, 20, 4))


def _drawn(rng: np.random.Generator, g: int, real: bool, word) -> tuple[str, bool]:  # noqa: ANN001
    """A span, and whether its form alone might be real, so that only a counter beside it tells."""
    if real:
        if g == 0:
            return _phone(rng, True), True
        if g == 1:
            return f"{word()} [at] {word()} [dot] {DOMAIN_ENDS[int(rng.integers(0, len(DOMAIN_ENDS)))]}" if rng.random() < 0.6 else f"{word()}(at){word()}.{DOMAIN_ENDS[int(rng.integers(0, len(DOMAIN_ENDS)))]}", True
        if g == 2:
            c = _card(rng)
            return "_./-"[int(rng.integers(0, 4))].join(c[i : i + 4] for i in range(0, 16, 4)), True
        if g == 3:
            return _ssn(rng, True), True
        if g == 4:
            return _iban(rng), True
        if g == 5:
            name = ("password=", "pwd: ", "secret=", "token = ", "api_key=")[int(rng.integers(0, 5))]
            body = _pick(rng, int(rng.integers(8, 40)), LOWER + DIGIT)
            return name + (body if re.search("[0-9]", body) else f"{body}7"), True
        return ("AKIA" + _pick(rng, 16, UPPER + DIGIT) if rng.random() < 0.5 else _pick(rng, int(rng.integers(20, 40)), UPPER + DIGIT)), True
    good = rng.random() < 0.5
    if g == 0:
        return _phone(rng, good), good
    if g == 1:
        return f"{word()}[at]{word()}.{_pick(rng, int(rng.integers(5, 9)), LOWER)}", False
    if g == 2:
        while True:
            c = _pick(rng, 16, DIGIT)
            if not _luhn(c):
                return "_./-"[int(rng.integers(0, 4))].join(c[i : i + 4] for i in range(0, 16, 4)), False
    if g == 3:
        return _ssn(rng, good), good
    if g == 4:
        while True:
            x = f"{_pick(rng, 2, UPPER)}{_pick(rng, 2, DIGIT)}{_pick(rng, 12, UPPER + DIGIT)}"
            if iban_rest(x) != 1:
                return x, False
    if g == 5:
        return f"{('token: ', 'secret=', 'password: ')[int(rng.integers(0, 3))]}{word()}{('ing', 'ed', 'ly')[int(rng.integers(0, 3))]}{word()}", False
    if rng.random() < 0.3:  # a checksum or serial, which only its name tells from a key
        return _pick(rng, int(rng.integers(16, 40)), UPPER + DIGIT), True
    return ("_".join(_pick(rng, int(rng.integers(5, 8)), UPPER) for _ in range(3)) if rng.random() < 0.7 else _pick(rng, 18, DIGIT)), False


def _candidate(rng: np.random.Generator, windows: tuple[str, ...] = ()) -> tuple[int, str, str, str, int]:
    """generator, before, span, after, label"""
    g, real = int(rng.integers(0, 7)), int(rng.integers(0, 2))
    word = lambda: _pick(rng, int(rng.integers(2, 9)), LOWER)
    one_of = lambda words: words[int(rng.integers(0, len(words)))]
    span, alike = _drawn(rng, g, bool(real), word)
    if windows:
        w = one_of(windows)
        before, after = f"{w[: len(w) // 2].rstrip()} ", f" {w[len(w) // 2 :].lstrip()}"
    else:
        before, after = f"{word()} {word()} ", f" {word()} {word()}"
    if rng.random() < (0.45 if real else 0.15):
        before = f"{before}{one_of(CLUES)} {one_of(('', 'is ', 'him at ', 'to ', 'no. '))}"
    if rng.random() < 0.2:  # a counter somewhere, in both classes
        before = f"{one_of(COUNTER)} {one_of(('of', 'and', 'she', 'was', 'in'))} {word()} {before}"[-CONTEXT:] if rng.random() < 0.5 else f"{before}{one_of(COUNTER)} {one_of(('is', 'and', 'was', 'for'))} {word()} "
    if not real and (alike or rng.random() < 0.5):
        if rng.random() < 0.75:
            before = f"{before}{one_of(COUNTER)}{one_of((' ', ' no. ', ': ', ' #', ' number '))}"
        else:
            after = f" {one_of(COUNTER)}{after}"
    return g, before[-CONTEXT:], span, after[:CONTEXT], real


def form_holds(g: int, span: str) -> bool:
    digits = re.sub("[^0-9]", "", span)
    if g == 0:
        return bool(re.search(PHONE_FORM, digits))
    if g == 1:
        return bool(re.search(EMAIL_FORM, span.lower()))
    if g == 3:
        return bool(re.search(SSN_FORM, span))
    return g == 4 and iban_rest(span) == 1


def features(g: int, before: str, span: str, after: str) -> list[float]:
    """What pii._features computes, for fitting."""
    before, after = before[-CONTEXT:].lower(), after[:CONTEXT].lower()
    digits = re.sub("[^0-9]", "", span)
    has = lambda x, pattern: int(bool(re.search(pattern, x)))
    return [
        *(int(g == k) for k in range(7)), len(span), len(digits), len(re.findall("[A-Z]", span)), len(re.findall("[a-z]", span)), len(re.findall("[^A-Za-z0-9]", span)), len(re.findall("[0-9][A-Z]|[A-Z][0-9]", span)),
        int(13 <= len(digits) <= 19 and _luhn(digits)), has(before, NEAR_CLUE), has(before, COUNTER_BEFORE), has(before, NEAR_COUNTER), has(after, COUNTER_AFTER), int(before[-1:] in tuple("#$%/=")), int(after[:1] in tuple("%/=_")), int(form_holds(g, span)),
    ]


def _rows(seed: int, windows: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    made = [_candidate(rng, windows) for _ in range(TRAIN_ROWS)]
    return np.array([features(*m[:4]) for m in made], float), np.array([m[4] for m in made], float), np.array([m[0] for m in made])


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    """Gain, feature and limit of the best cut."""
    best = (1e-6, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for limit in np.unique(x[:, f])[:-1][:40]:
            low = x[:, f] <= limit
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
            if gain > best[0]:
                best = (float(gain), f, float(limit))
    return best


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple:
    gain, f, limit = _split(x, g, h) if depth and len(x) > 20 else (0, -1, 0)
    if f < 0:
        return (round(RATE * float(g.sum() / (h.sum() + 1)), 6),)
    low = x[:, f] <= limit
    return (f, limit, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _leaf(t: tuple, row: np.ndarray) -> float:
    while len(t) > 1:
        t = t[2] if row[t[0]] <= t[1] else t[3]
    return t[0]


def scored(model: Model, x: np.ndarray) -> np.ndarray:
    return np.array([sum(_leaf(t, r) for t in model.trees) for r in x])


@functools.lru_cache(maxsize=4)
def fitted(windows: tuple[str, ...] = ()) -> Model:
    """windows: texts of about 2 * CONTEXT characters that candidates are put into."""
    x, y, _ = _rows(7, windows)
    trees: list[tuple] = []
    s = np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-s))
        t = _grow(x, y - p, p * (1 - p), 3)
        trees.append(t)
        s += np.array([_leaf(t, r) for r in x])
    x, y, g = _rows(8, windows)
    s = scored(Model(0.0, trees, {}), x)
    thresholds = {}
    for kind in dict.fromkeys(GENERATOR_KINDS):
        mine = np.isin(g, [k for k, v in enumerate(GENERATOR_KINDS) if v == kind])
        good = [c for c in np.unique(s[mine]) if y[mine][s[mine] >= c].mean() >= PRECISION]
        recall = {c: y[mine][s[mine] >= c].sum() for c in good}
        thresholds[kind] = round(float(max(c for c in good if recall[c] >= NEARLY * max(recall.values()))) - 1e-3, 4) if good else float("inf")
    return Model(0.0, trees, thresholds)
