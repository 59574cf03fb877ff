"""Headings against paragraphs: golden rows of the rules, and the chain against all chains."""
import itertools
import random

import pytest

from palimpsest.operators import headmatch as H

#: paragraphs, (title, level), parts, chapters
GOLDEN = [
    ([], [("Intro", 1)], [], []),
    (["Introduction", "Some body text."], [], [], []),
    (["Some preamble.", "Part One", "Chapter A", "Body text."], [("Part One", 1), ("Chapter A", 2)], [1], [2]),
    (["Preamble.", "Chapter 1", "Body text."], [("Chapter 1", 2)], [], [1]),
    (["INTRODUCTION", "Body text."], [("Introduction", 2)], [], [0]),
    (["A  World   on Fire", "Body."], [("A World on Fire", 2)], [], [0]),
    (["Introduction: The Early Years", "Body text here."], [("Introduction", 2)], [], [0]),
    (["This is a very long body paragraph that happens to contain the word Introduction somewhere in it and should not match."], [("Introduction", 2)], [], []),
    (["Chapter One", "Body.", "Chapter Two", "Body.", "Chapter Three", "Body."], [("Chapter One", 1), ("Chapter Two", 1), ("Chapter Three", 1)], [], [0, 2, 4]),
    (["Part One", "Chapter 1", "Body."], [("Part One", 1), ("Chapter 1", 2)], [0], [1]),
    (["Alpha", "Beta", "Gamma", "Delta"], [("Delta", 2), ("Alpha", 2), ("Gamma", 2)], [], [0, 2, 3]),
    (["Introduction", "Body text."], [("Introduction", 2), ("Introduction", 2)], [], [0]),
    (["Some other text.", "More body."], [("Completely Missing Title", 2)], [], []),
    (["A", "Body text."], [("A", 2)], [], []),
    (["Notes", "x", "Notes", "y", "Notes"], [("Notes", 2), ("Notes", 2)], [], [0, 2]),
]


def test_golden(spark):
    heads = [(k, n, t, lv) for k, (_, hs, _, _) in enumerate(GOLDEN) for n, (t, lv) in enumerate(hs)]
    paras = [(k, n, t) for k, (ps, _, _, _) in enumerate(GOLDEN) for n, t in enumerate(ps)]
    h = spark.createDataFrame([*heads, (99, 0, None, 1)], "doc_id long, place int, title string, level int")
    p = spark.createDataFrame([*paras, (99, 0, None), (99, 1, "")], "doc_id long, place int, text string")
    got = H.roles(h, H.matched(h, p)).collect()
    for k, (_, _, parts, chapters) in enumerate(GOLDEN):
        mine = [(r["role"], r["paragraph"]) for r in got if r["doc_id"] == k]
        assert sorted(x for r, x in mine if r == "part") == parts and sorted(x for r, x in mine if r == "chapter") == chapters, k
    assert H.matched(h.limit(0), p).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_chain_is_the_heaviest(seed):
    rng = random.Random(seed)
    rows = list({(rng.randrange(6), rng.randrange(7)): None for _ in range(rng.randrange(1, 10))})
    rows = [(a, b, rng.choice([400, 450, 1000])) for a, b in rows]
    weight = {(a, b): w for a, b, w in rows}
    best = 0
    for n in range(1, len(rows) + 1):
        for some in itertools.combinations(sorted(rows), n):
            if all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(some)):
                best = max(best, sum(r[2] for r in some))
    got = H.chain(rows)
    assert sum(weight[x] for x in got) == best and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))


def test_many_headings_of_one_title(spark):
    """Repeated titles meet within the band, not each with each."""
    h = spark.range(3000).selectExpr("1L AS doc_id", "cast(id AS int) AS place", "'Notes' AS title", "1 AS level")
    p = spark.range(3000).selectExpr("1L AS doc_id", "cast(id AS int) AS place", "'notes' AS text")
    assert H.pairs(h, p).count() <= 3000 * (H.BAND + 1)
    assert H.matched(h, p).where("place = paragraph").count() == 3000


def test_documents_go_through_together(spark):
    """Titles of 3 and of 16 words; no task is a document's, and only runs of a title's length are held against titles."""
    long = " ".join(f"long{k}" for k in range(16))
    h = spark.createDataFrame([(k, n, t) for k in range(60) for n, t in enumerate(("a b c", long))], "doc_id long, place int, title string")
    p = spark.createDataFrame([(k, n, t) for k in range(60) for n, t in enumerate(("x a b c y z", "a b", long, f"{long} more"))], "doc_id long, place int, text string")
    met = H.matched(h, p)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert sorted(map(tuple, met.collect())) == sorted(x for k in range(60) for x in ((k, 0, 0, False), (k, 1, 2, True)))


def _plain(titles, texts):
    """All headings against all paragraphs, one by one."""
    split = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    met = {}
    for a, t in enumerate(map(split, titles)):
        for b, p in enumerate(map(split, texts)):
            if t == p:
                met[a, b] = H.EXACT
            elif len(p) <= H.SHORT and any(p[k : k + len(t)] == t for k in range(len(p))):
                met[a, b] = int(H.WITHIN + 100 * len(t) / len(p))
    taken = dict(H.chain([(a, b, w) for (a, b), w in met.items()]))
    for (a, b), w in sorted(met.items()):
        if w == H.EXACT and a not in taken and b not in taken.values():
            taken[a] = b
    return sorted((a, b, met[a, b] == H.EXACT) for a, b in taken.items())


def test_every_heading_of_a_title_meets_every_paragraph(spark):
    """A title that many paragraphs hold before the one that is it; headings before their k-th and after their last paragraph; and odd mixtures."""
    rng = random.Random(4)
    docs = [(["Notes"], [*(f"notes on {k}" for k in range(12)), "Notes"]), (["Notes", "Chapter 1", "Notes"], ["Chapter 1", "Notes"]), (["Notes"] * 14 + ["End"], ["x", *["Notes"] * 30, "End", "Notes"])]
    docs += [([rng.choice(("ab", "cd", "ab cd", "ef")) for _ in range(rng.randrange(1, 25))], [rng.choice(("ab", "cd", "ab cd", "ab cd ef", "cd ef gh", "ef")) for _ in range(rng.randrange(1, 40))]) for _ in range(40)]
    h = spark.createDataFrame([(k, n, t) for k, (hs, _) in enumerate(docs) for n, t in enumerate(hs)], "doc_id long, place int, title string")
    p = spark.createDataFrame([(k, n, t) for k, (_, ps) in enumerate(docs) for n, t in enumerate(ps)], "doc_id long, place int, text string")
    got = H.matched(h, p).collect()
    assert [(x["paragraph"], x["exact"]) for x in got if x["doc_id"] == 0] == [(12, True)]
    for k, (titles, texts) in enumerate(docs):
        assert sorted(tuple(x)[1:] for x in got if x["doc_id"] == k) == _plain(titles, texts), k


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_unlisted_pairs_give_the_same_chain(fan, monkeypatch):
    monkeypatch.setattr(H, "FAN", fan)
    rng = random.Random(fan)
    for _ in range(150):
        offers = {(k,): {p: rng.choice((400, 450, 1000)) for p in rng.sample(range(30), rng.randrange(1, 20))} for k in range(4)}
        of = {place: (rng.randrange(4),) for place in rng.sample(range(60), rng.randrange(1, 40))}
        assert H.long_chain(of, offers) == H.chain([(place, p, w) for place, kind in of.items() for p, w in offers[kind].items()])
