"""Neighbour search against brute force."""
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from palimpsest.llm import nn_descent, queries

SCHEMA = "vec_id long, embedding array<double>, node long, code string"


def plain(rows, asked, k=5):
    """Exact answers; rows: (id, unit vector)."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = x @ x[int(np.flatnonzero(ids == q)[0])]
        order = [i for i in np.lexsort((ids, -s.round(12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def recall(got, want):
    hit = 0
    for q, best in want.items():
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1)), q
        assert all(x["score"] >= y["score"] for x, y in zip(rows, rows[1:], strict=False))
        hit += len({r["vec_id"] for r in rows} & {i for i, _ in best})
        for r in rows:
            for i, s in best:
                assert i != r["vec_id"] or math.isclose(s, r["score"], rel_tol=1e-9, abs_tol=1e-12)
    return hit / sum(len(b) for b in want.values())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table(spark, sf):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet").to_pylist()
    want = plain([(r["vec_id"], r["embedding"]) for r in t], [r["vec_id"] for r in t if r["vec_id"] % 50 == 0])
    got = queries.op11_nn_descent(spark, f"/root/testdata/{sf}").collect()
    assert {r["query_id"] for r in got} == set(want)
    assert recall(got, want) >= 0.9


def test_descent_carries_what_the_first_lists_miss(spark, monkeypatch):
    """Small blocks, short lists: the graph's own recall rises by rounds and copies do not fill it."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24))
    x[:900] = x[0]  # equal vectors
    x[900:1800] = x[900] + 0.03 * rng.standard_normal((900, 24))  # near copies
    rows = [(k, v.tolist(), k, "c") for k, v in enumerate(x)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    monkeypatch.setattr(nn_descent, "BLOCK", 64)
    monkeypatch.setattr(nn_descent, "ORDERS", 3)
    index = nn_descent.build(docs, "vec_id", "embedding")
    assert index.classes.count() == 2101 and index.links.agg({"nbrs": "max"}).count() == 1
    first = nn_descent.merged(nn_descent.first_lists(index.codes, 24))
    assert index.graph.selectExpr("sum(aggregate(sims, 0L, (a, b) -> a + b))").first()[0] > first.selectExpr("sum(aggregate(sims, 0L, (a, b) -> a + b))").first()[0]
    asked = [k for k in range(3000) if k % 50 == 0]
    got = nn_descent.search(index, docs.where("vec_id % 50 = 0"), "vec_id", "embedding").collect()
    want = plain([r[:2] for r in rows], asked)
    assert recall(got, want) >= 0.9
    for r in got:
        if r["query_id"] < 900:  # copies: the smallest ids, the query left out
            assert (r["vec_id"], round(r["score"], 12)) == (want[r["query_id"]][r["rank"] - 1][0], 1.0)


def test_odd_rows_and_queries_from_outside(spark):
    bad = [(50, None), (100, []), (150, [0.0, 0.0]), (200, [1.0, None]), (250, [math.nan, 1.0]), (300, [math.inf, 1.0]), (350, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (400, [1e300, 1e300]), (5, [1e-300, 0.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame([(k, v, 1, "c") for k, v in bad + good], SCHEMA)
    index = nn_descent.build(table, "vec_id", "embedding")
    got = [tuple(r) for r in nn_descent.search(index, table.where("vec_id % 50 = 0"), "vec_id", "embedding").orderBy("query_id", "rank").collect()]
    half = math.sqrt(0.5)
    want = [(0, 1, 1, 1.0), (0, 2, 5, 1.0), (0, 3, 400, half), (0, 4, 2, 0.0), (0, 5, 3, -1.0), (400, 1, 0, half), (400, 2, 1, half), (400, 3, 2, half), (400, 4, 5, half), (400, 5, 3, -half)]
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(math.isclose(x[3], y[3], abs_tol=1e-12) for x, y in zip(got, want, strict=True))
    outside = spark.createDataFrame([(1000, [0.1, 0.9]), (1001, None)], "id long, v array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in nn_descent.search(index, outside, "id", "v", 1).collect()] == [(1000, 2)]
    none = table.limit(0)
    assert nn_descent.search(nn_descent.build(none, "vec_id", "embedding"), none, "vec_id", "embedding").count() == 0
    one = table.where("vec_id = 2")
    assert nn_descent.search(nn_descent.build(one, "vec_id", "embedding"), one, "vec_id", "embedding").count() == 0


def test_first_lists_are_the_nearest_of_their_blocks(spark):
    x = np.random.default_rng(2).standard_normal((500, 12))
    index = nn_descent.build(spark.createDataFrame([(k, v.tolist(), 0, "") for k, v in enumerate(x)], SCHEMA), "vec_id", "embedding")
    lists = {r["node"]: r for r in nn_descent.merged(nn_descent.first_lists(index.codes, 12)).collect()}  # one block holds all
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for k, r in lists.items():
        assert k not in r["nbrs"] and len(r["nbrs"]) == nn_descent.LIST and r["sims"] == sorted(r["sims"], reverse=True)
        assert len(set(r["nbrs"]) & set(np.argsort(-s[k])[: nn_descent.LIST].tolist())) >= nn_descent.LIST - 2
