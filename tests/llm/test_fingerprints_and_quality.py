"""Full blocks of fingerprints, null ids, and the quadratic discriminant by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitquarry.llm import quality, simhash
from bitquarry.llm.components import components
from llm.test_operators_brute_force import documents, roots


@pytest.mark.parametrize("cap", [1, 4, 32])
def test_full_blocks_with_full_and_other_cells(spark, cap):
    rng = random.Random(4)
    base = rng.getrandbits(32) << 32
    values = {base | rng.getrandbits(32) for _ in range(120)}  # one full block, cells of all sizes
    dense = base | 0x1234
    values |= {dense ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(120)}  # a full cell
    values |= {v ^ 1 ^ (1 << rng.randrange(64)) for v in list(values)[:60]}
    signed = sorted(simhash._as_long(v) for v in values)
    got = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), cap)).collect()}
    want = roots(signed, [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert {n: got.get(n, n) for n in signed} == want


def test_null_ids_and_copies(spark):
    text = "One plain text with several words in it, and some more of them."
    df = documents(spark, [(None, text, "en", "a"), (7, text, "en", "a"), (5, text.upper(), "en", "a"), (None, "all alone here", "en", "a"), (9, None, "en", "a"), (8, "  ", "en", "a"), (7, "quite another text of seven words", "en", "a")])
    rows = simhash.groups(df).collect()
    by = sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows)
    assert by == sorted([("None", "5"), ("7", "5"), ("5", "5"), ("None", "None"), ("9", "8"), ("8", "8"), ("7", "7")])


def test_discriminant_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: quality.statistics(r["text"] or "") for r in docs.collect()}
    known = labels.where(~quality.held_out(F.col("doc_id"))).collect()
    x = [np.array([rows[r["doc_id"]] for r in known if r["quality"] == y and r["doc_id"] in rows]) for y in (0, 1)]
    n = np.array([len(v) for v in x])
    cov = [np.cov(v.T, bias=True) for v in x]
    pooled = np.diag((n[0] * np.diag(cov[0]) + n[1] * np.diag(cov[1])) / n.sum())

    def density(v, y):
        c = 0.9 * cov[y] + 0.1 * pooled + 0.001 * np.eye(len(v))
        d = v - x[y].mean(0)
        return np.log(n[y] / n.sum()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d)

    for r in quality.score(docs, labels).collect():
        v = np.array(rows[r["doc_id"]])
        want = 1 / (1 + np.exp(-np.clip((density(v, 1) - density(v, 0)) / 4, -700, 700)))
        assert abs(r["score"] - want) < 1e-6
