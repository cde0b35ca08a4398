"""The pipeline's near duplicates take every link of op5's fingerprints, and those of shingle sets."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from bitquarry.llm import simhash
from llm.test_operators_brute_force import documents, fingerprint, roots


def kinds(texts):
    """The pairs that fingerprints link, and those that shingle sets link, by brute force."""
    ids = sorted(texts)
    fps = {i: fingerprint(texts[i]) for i in ids}
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    return [(a, b) for a, b in pairs if (fps[a] ^ fps[b]).bit_count() <= 2], [(a, b) for a, b in pairs if simhash.jaccard(texts[a], texts[b], 5) >= 0.8]


def edited(rng, base, most):
    """base with changed words, until its fingerprint is near and its set of shingles is not."""
    own = fingerprint(" ".join(base))
    while True:
        x = list(base)
        for at in rng.sample(range(len(base)), most):
            x[at] = f"new{rng.randrange(10**6)}"
        if 1 <= (fingerprint(" ".join(x)) ^ own).bit_count() <= 2 and simhash.jaccard(" ".join(base), " ".join(x), 5) < 0.8:
            return x


def test_links_of_both_kinds(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = {}
    for _ in range(3):
        # Near by fingerprints, then by sets from there: one group.
        base = words(200)
        x = edited(rng, base, 6)
        at = rng.randrange(150)
        y = [*x[:at], *words(12), *x[at + 12 :]]
        # A line so often that the fingerprints are equal; the ends share no shingle.
        line = words(13) * 40
        for t in (y, base, x, [*line, *words(9)], [*line, *words(9)]):
            texts[len(texts)] = " ".join(t)
    texts |= {100 + k: " ".join(words(n)) for k, n in enumerate((1, 2, 4, 30, 300))} | {200: "", 201: None}
    by_fp, by_set = kinds(texts)
    want = roots(texts, by_fp + by_set)
    assert roots(texts, by_fp) != want != roots(texts, by_set)
    df = documents(spark, [(i, t, "en", "a") for i, t in texts.items()] + [(None, texts[0], "en", "a")])
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert {r["doc_id"] for r in kept.collect()} == {*want.values(), None}
    got = {r["id"]: r["group_id"] for r in simhash.similar_groups(df, cap=1).collect()}
    assert {i: got.get(i, i) for i in texts} == want


def test_stage_drops_what_op5_links(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    own = simhash.groups(docs).where("doc_id <> component_id").select("doc_id", "component_id")
    gone = {r["doc_id"] for r in own.collect()}
    some = docs.join(own, "doc_id", "left_semi").union(docs.join(own.select(F.col("component_id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, some, "").collect()}
    assert len(gone) > 300
    assert not kept & gone
