"""Collocations against counts by dictionary."""
import collections
import re

import pyarrow as pa
import pytest

from palimpsest.llm import collocations as C


def plain(rows, max_n=3, least=10, inside=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    c = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in c.items():
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        held = any(o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= inside * a for (o, q), b in c.items())
        if not held:
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(best)]
    return ranked


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


ODD = [("x 20%20\ty", "odd lang " * 7), (None, "New York. new york, NEW YORK"), ("en", None), ("en", ""), ("en", " \t . , "), ("de", "a\x01 a b a\x00b a b\x01c")] * 6 + [("en", "the cat sat on the mat " * 40), ("en", "the cat\nsat on. the cat sat"), ("xx", "one"), ("de", "x y x y x y x y x y x y x y x y x y x y x y"), ("en", "Ä É ä é " * 12)]


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_odd_rows(spark, max_n):
    docs = spark.createDataFrame([(k, x, t, "c") for k, (x, t) in enumerate(ODD)], "doc_id long, lang string, text string, phrase string").repartition(4)
    assert rows_of(C.collocations(docs, max_n, 5)) == plain(ODD, max_n, 5)
    assert rows_of(C.collocations(docs, max_n, 5, 100, 3)) == plain(ODD, max_n, 5, 100, 3)
    assert C.collocations(docs.limit(0)).count() == 0


def test_hot_words_are_dealt_out_and_counted_whole(spark, monkeypatch):
    rows = [("en", " ".join(f"the w{(7 * k + j) % 40} the cat x{j % 9}" for j in range(60))) for k in range(30)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    hot = C.hot_heads(docs)
    assert "en\tthe" in hot and "en\tthe cat" in hot
    dealt = C.suffixes(docs, 3, hot)
    assert dealt.where("key LIKE 'en\t3the cat %'").select("salt").distinct().count() == 9
    assert rows_of(C.collocations(docs)) == plain(rows)
    monkeypatch.setattr(C, "LOT", 100)  # runs go over many lots
    assert rows_of(C.collocations(docs)) == plain(rows)


def test_stack_over_lots():
    stack = C.Stack(2, 1)
    lots = [[("en\t1b c ", 1), ("en\t1b a ", 2)], [("en\t1b a ", 3), ("en\t1b ", 1)], [("en\t1b ", 1), ("en\t1a ", 5)]]
    out = collections.Counter()
    for lot in lots:
        b = pa.RecordBatch.from_pydict({"key": [x for x, _ in lot], "n": [n for _, n in lot]})
        for r in stack.put(b):
            out.update({x["key"]: x["f"] for x in r.to_pylist()})
    for r in stack.rest():
        out.update({x["key"]: x["f"] for x in r.to_pylist()})
    assert out == {"en\t1b": 8, "en\t1b c": 1, "en\t1b a": 5, "en\t1a": 5, "en": 13}


def test_many_words_and_long_suffixes(spark):
    rows = [("en", " ".join(f"w{k}" for k in range(70_000))), ("en", "a b c d e f " * 12)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert rows_of(C.collocations(docs, 4)) == plain(rows, 4)
