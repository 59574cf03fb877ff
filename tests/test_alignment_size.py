"""Greedy matching of titles: the rows of holding each against each, and five thousand headings in seconds."""
import random
import time

import pytest

from palimpsest.operators import alignment as A


def plain(marks, heads):
    free, out = dict(enumerate(heads)), []
    for title in marks:
        best, score = None, 0.0
        for k, t in free.items():
            s = A._alike(title, t)
            if s > score:
                best, score = k, s
        if best is None or score < A.LEAST_TITLE:
            out.append((None, 0.0))
        else:
            del free[best]
            out.append((best, score))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_rows_are_those_of_all_pairs(seed):
    rng = random.Random(seed)
    words = ["chapter", "one", "two", "the", "war", "of", "ende", "peace", "ö", "xii"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(4)))
    heads = [title() for _ in range(60)]
    marks = [rng.choice(heads)[: rng.randrange(3, 30)] + rng.choice(["", "s", " a"]) for _ in range(50)] + ["", "zzz"]
    free = A.Free(heads)
    assert [free.take(t) for t in marks] == plain(marks, heads)


def test_five_thousand_headings():
    rng = random.Random(1)
    heads = [f"chapter {k} of the {rng.choice(['long', 'short'])} road {rng.randrange(10**6)}" for k in range(5000)]
    marks = [h if k % 10 else h.replace("road", "raod") for k, h in enumerate(heads)]
    began, free = time.perf_counter(), A.Free(heads)
    got = [free.take(t) for t in marks]
    assert time.perf_counter() - began < 60
    assert sum(k == g for k, (g, _) in enumerate(got)) > 4900
