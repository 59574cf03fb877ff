"""The pipeline's near-duplicate stage against all pairs."""
import collections
import math
import random

import numpy as np

import corpus_pipeline
from palimpsest.llm import near_copies


def plain_components(rows, width=5, similarity=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def planted():
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, passage = [], say(40)
    for k in range(40):
        w = say(300)
        texts.append(w)
        for changes in (1, 3, 5, 7, 9):
            v = list(w)
            for at in rng.sample(range(300), changes):
                v[at] = f"new{k}_{changes}_{at}"
            texts.append(v)
    texts += [say(150) + passage for _ in range(90)] + [passage + [f"end{k}"] for k in range(90)]
    rows = [" ".join(w) for w in texts] + [None, "", " \n", "one", "ONE", "two words", "a b c d e", "a b c d e f", "É x"]
    rng.shuffle(rows)
    return [*enumerate(rows), (3, rows[3]), (None, rows[5]), (None, "nobody's text")]


def held_against_all_pairs(spark, rows):
    """Share of the rows that all pairs tie to a smaller doc_id and that components() does too; nothing else may be tied."""
    label = plain_components(rows)
    low = {}
    for (k, _), c in zip(rows, label, strict=True):
        if k is not None:
            low[c] = min(low.get(c, k), k)
    want = collections.Counter((k, low.get(c)) for (k, _), c in zip(rows, label, strict=True))
    got = [tuple(r) for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(got) == len(rows)
    least = {k: c for k, c in want if k is not None}
    assert all(c is None or least[c] == least[k] for k, c in got if k is not None)
    copies = [(k, c) for k, c in got if k is not None and least[k] != k]
    return sum(c != k for k, c in copies) / len(copies)


def test_components_against_all_pairs(spark):
    assert held_against_all_pairs(spark, planted()) >= 0.98
    assert near_copies.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_values_are_salted(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", 4)
    monkeypatch.setattr(near_copies, "SALTS", 3)
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    rows = []
    for k in range(120):
        v = list(base)
        for at in rng.sample(range(400), 1 + k % 6):
            v[at] = f"new{k}_{at}"
        rows.append((k, " ".join(v)))
    assert held_against_all_pairs(spark, rows) >= 0.98


def test_fingerprints_are_majorities():
    texts = ["a b c d e f g h", "", None, "one", "x y z " * 500, " ".join(f"w{k}" for k in range(4000))]
    h, n = near_copies.shingle_sets(texts)
    got = near_copies.fingerprints(h, n)
    for k, some in enumerate(np.split(h, np.cumsum(n)[:-1])):
        for w in range(near_copies.WORDS):
            values = near_copies._mix(some + np.uint64(w * int(near_copies.MULTIPLY) & (1 << 64) - 1))
            assert int(got[k, w]) == sum(1 << b for b in range(64) if 2 * int(((values >> np.uint64(b)) & np.uint64(1)).sum()) > len(some))


def test_plans_find_what_they_promise():
    for n in (50, 5000, 10**7):
        both = np.full((near_copies.BITS, near_copies.BITS), n / 4)
        np.fill_diagonal(both, n / 2)
        parts = near_copies.plan(both, n)
        used = [b for part, _ in parts for b in part]
        assert len(set(used)) == len(used)
        miss = math.prod(1 - near_copies._within([near_copies.turn(0.8)] * len(part), t) for part, t in parts)
        assert miss <= 0.12 or len(parts) * len(parts[0][0]) > near_copies.BITS - len(parts[0][0])


def test_stage_drops_copies_with_few_words_changed(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((k, " ".join(w), "x"))
        for c in (1, 2, 3):
            v = list(w)
            for at in rng.sample(range(300), c):
                v[at] = "other"
            rows.append((1000 * c + k, " ".join(v), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(60))


def test_no_pair_is_left_out(spark, monkeypatch):
    """Pairs just at the limit, which fingerprints find with probability FOUND only, beside lines that many texts hold."""
    rng = random.Random(3)
    line = [f"line{k}" for k in range(30)]
    rows = []
    for k in range(150):
        w = [f"w{rng.randrange(10**6)}" for _ in range(96)]
        v = list(w)
        for at in (20, 60):  # ten of 92 shingles differ: 82 / 102 = 0.804
            v[at] = f"new{k}_{at}"
        rows += [" ".join(w), " ".join(v)]
    rows += [" ".join([*(f"x{k}_{j}" for j in range(14)), *line]) for k in range(60)]
    monkeypatch.setattr(near_copies, "FREQUENT", 4)
    assert held_against_all_pairs(spark, list(enumerate(rows))) == 1
    found = near_copies.candidate_ties
    monkeypatch.setattr(near_copies, "candidate_ties", lambda nodes, similarity: found(nodes, similarity).where("false"))
    assert held_against_all_pairs(spark, list(enumerate(rows))) == 1


def test_a_family_just_below_the_limit_is_not_paired(spark, monkeypatch):
    """Each text lacks 35 of 296 shingles that the others share, so no two are similar: there is nothing to verify pair by pair."""
    rng = random.Random(8)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(300)], []
    for k in range(150):
        v = list(base)
        for at in range(7):
            v[5 + 40 * at + (k * 7 + at * 3) % 33] = f"own{k}_{at}"
        rows.append((k, " ".join(v)))
    real, met = near_copies.verified, []

    def counted(ties, *rest):
        met.append(ties.count())
        return real(ties, *rest)

    monkeypatch.setattr(near_copies, "verified", counted)
    got = near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got) and met[-1] <= len(rows)


def test_texts_that_share_a_tenth_are_not_read_whole(spark, monkeypatch):
    """Ten texts each hold one passage, 26 of their 296 shingles: some are among the first of each, too few for a partner."""
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passages = [say(30) for _ in range(12)]
    rows = [(k, " ".join([*say(100), *passages[k % 12], *say(170)])) for k in range(120)]
    real, read = near_copies._sets_of, []

    def counted(met, *rest):
        read.append(met.count())
        return real(met, *rest)

    monkeypatch.setattr(near_copies, "_sets_of", counted)
    got = near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got) and max(read) <= len(rows) // 10


def test_no_pair_of_unequal_size_is_left_out(spark, monkeypatch):
    """A text and its start, at the limit and just below it, of any size; the shorter took fewer shingles ahead."""
    rng = random.Random(10)
    rows = []
    for k in range(160):
        n = rng.randrange(1, 130)
        w = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        rows += [" ".join(w), " ".join(w[: math.ceil(0.8 * n) + 4 - k % 2])]
    found = near_copies.candidate_ties
    monkeypatch.setattr(near_copies, "candidate_ties", lambda nodes, similarity: found(nodes, similarity).where("false"))
    assert held_against_all_pairs(spark, list(enumerate(rows))) == 1
