"""Cells, routes and blocks of the top-k search."""

import numpy as np
import pytest

from bitquarry.llm import topk


def brute(rows, every=50, k=5):
    """The result by all products, for vectors of finite components."""
    out = set()
    rows = sorted({(i, tuple(x)) for i, x in rows if i is not None and x is not None})
    for q, x in rows:
        if q % every:
            continue
        best = {}
        for i, y in rows:
            if i != q and len(x) == len(y):
                s = int(sum(np.floor(256 * np.float64(a)) * np.floor(256 * np.float64(b)) for a, b in zip(x, y)))
                best[i] = max(s, best.get(i, s))
        out |= {(q, n, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def got(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("how", [{}, {"block": 16, "query_block": 3, "sample": 20, "least_cells": 5}])
def test_lengths_repeats_and_a_hot_vector(spark, how):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=4), 2)]) for k in range(160)]
    rows += [(1000 + k, rows[3][1]) for k in range(120)]  # one vector in nearly half of all rows
    rows += [(2000 + k, [float(x) for x in np.round(rng.normal(size=2), 2)]) for k in range(30)] + [(3000, []), (3050, []), (3100, [1.5])]
    rows += rows[:60] + [(50, [9.0, 9.0, 9.0, 9.0]), (7, [1.0, 2.0, 3.0, 4.0])]  # repeated rows, and ids with two vectors
    wanted = brute(rows)
    # A query id with two vectors has the better score of each pair.
    merged = {}
    for q, _, i, s in wanted | {(50, 0, i, s) for q, _, i, s in brute([(i, x) for i, x in rows if i != 50 or x != rows[50][1]]) if q == 50} | {(50, 0, i, s) for q, _, i, s in brute([(i, x) for i, x in rows if i != 50 or x != [9.0] * 4]) if q == 50}:
        merged.setdefault(q, {})[i] = max(s, merged.get(q, {}).get(i, s))
    want = {(q, n, i, s) for q, of in merged.items() for n, (i, s) in enumerate(sorted(of.items(), key=lambda t: (-t[1], t[0]))[:5], 1)}
    assert got(topk.top_k(frame(spark, rows), **how)) == want


def test_routes_on_clusters_are_few(spark):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(40, 6)) * 4
    rows = [(k, [float(x) for x in np.round(centres[k % 40] + rng.normal(size=6) * 0.01, 3)]) for k in range(2000)]
    made = []
    real = topk._routed
    topk._routed = lambda *a: made.append(real(*a)) or made[-1]
    try:
        found = got(topk.top_k(frame(spark, rows), least_cells=40))
    finally:
        topk._routed = real
    assert found == brute(rows)
    # 40 queries and 40 cells: of 1600 pairs few remain.
    assert made[0].count() < 400


def test_distinct_keeps_the_smallest_ids():
    x = np.array([[1.0, 2.0]] * 6 + [[3.0, 4.0]] * 2)
    ids = np.array([9, 8, 7, 7, 6, 5, 1, 1])
    assert sorted(ids[topk.distinct(ids, x, 3)].tolist()) == [1, 5, 6, 7]
    assert len(topk.distinct(ids[:0], x[:0], 3)) == 0


def test_batches_equal_one_product():
    rng = np.random.default_rng(11)
    x = np.floor(256 * rng.normal(size=(3000, 16)))
    s = topk.Search(np.arange(200), x[:200], np.arange(3000), x, 5)
    s.run()
    g = np.where(np.arange(200)[:, None] == np.arange(3000)[None, :], -np.inf, x[:200] @ x.T)
    assert np.array_equal(s.scores, -np.sort(-g, axis=1)[:, :5])
