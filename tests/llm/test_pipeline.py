"""The corpus pipeline's stages and its whole run."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from bitquarry.llm import simhash
from bitquarry.llm.tables import cut
from llm.test_operators_brute_force import documents, roots

SF = "/root/testdata/sf0.01"


def test_stages_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    sources = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        out = cut(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        after = {r["doc_id"] for r in out.collect()}
        assert after <= before
        if name in ("quality", "language"):
            # Clean documents stay.
            assert len(after & good) >= 0.99 * len(before & good)
        if name == "quality":
            assert len(after) < len(before)
        if name == "near_duplicates":
            sets = {i: set(simhash.shingle_hashes(simhash.word_list(texts[i]), 5).tolist()) for i in before}
            ids = sorted(before)
            alike = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (not sets[a] and not sets[b]) or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
            assert after == set(roots(ids, alike).values())
        if name == "mixing":
            sizes = F.size(F.split(F.trim("text"), r"\s+"))
            sources = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(sizes).alias("n")).collect()}
        docs = out
    total, order = sum(sources.values()), sorted(sources)
    shares = np.array([sources[s] / total for s in order])
    weights = np.array([1.0, 2.0, 3.0] * len(order))[: len(order)]
    assert np.corrcoef(shares, weights)[0, 1] > 0.8
    pieces = corpus_pipeline.packing_stage(spark, docs, SF)
    assert pieces.where("start = 0").count() == docs.count()


def test_run_equals_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf))
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(ran.columns) == sorted(docs.columns)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"]) for r in df.groupBy("doc_id").agg(F.sum("length").alias("length"), F.min("start").alias("start")).collect())
    assert key(ran) == key(docs)


def test_stages_on_awkward_rows(spark):
    rng = random.Random(8)
    filler = [(100 + k, " ".join(rng.choice(["the", "cat", "sat", "down", "and", "then", "left."]) for _ in range(50)), "en", "a") for k in range(20)]
    for docs in (documents(spark), documents(spark).union(documents(spark, filler)), documents(spark).where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = cut(stage(spark, docs, "/root/testdata/sf0.001"))
            assert out.columns == docs.columns, name
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
