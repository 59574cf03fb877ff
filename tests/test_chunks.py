"""Pieces of texts: the plain rules, and texts of some megabytes in seconds."""
import random
import re
import time

from pyspark.sql import functions as F

from palimpsest.functions import edits as E

ODD = [None, "", " \n", ".", "a.b c!d", "One two three.  Four\u2003five;\u00a0six , seven: eight?\u3000nine", "w " * 30, ". . . a", "x;\x1cy;\x85z " * 9]


def plain(text, most):
    """Sentences, clauses and words are packed one after another."""
    if text is None:
        return None

    def packed(units):
        held, out = [], []
        for u in units:
            if held and sum(len(x.split()) for x in held) + len(u.split()) > most:
                out.append(" ".join(held))
                held = []
            held.append(u)
        return out + ([" ".join(held)] if held else [])

    cut = lambda t, marks: [u.strip() for u in re.split(rf"(?<=[{marks}])\s+", t) if u.strip()]
    out = []
    for x in packed(cut(text, ".!?")):
        for y in [x] if len(x.split()) <= most else packed(cut(x, ";,:")):
            w = y.split()
            out += [y] if len(w) <= most else [" ".join(w[k : k + most]) for k in range(0, len(w), most)]
    return out


def test_pieces_are_those_of_the_plain_rules(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["ab", "c", " ", "  ", "\n", ". ", "; ", ", ", "!", "? "]) for _ in range(rng.randrange(200))) for _ in range(100)]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for most in (1, 4, 100):
        got = {r["k"]: r["x"] for r in d.select("k", E.chunks(F.col("t"), most).alias("x")).collect()}
        assert [got[k] for k in range(len(texts))] == [plain(t, most) for t in texts]


def test_megabytes_in_seconds(spark):
    rng = random.Random(4)
    say = lambda: "".join(rng.choice(["word", "another", "of"]) + rng.choice([" ", " ", " ", ", ", ". "]) for _ in range(4000))
    d = spark.createDataFrame([(say(),) for _ in range(40)], "t string").coalesce(1).selectExpr("explode(array_repeat(t, 12)) AS t").localCheckpoint()
    made = d.select(F.sum(F.size(E.chunks(F.col("t")))).alias("n"))
    made.collect()
    began = time.perf_counter()
    assert made.first()["n"] >= 480 * 40
    assert time.perf_counter() - began < 8
