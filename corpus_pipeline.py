"""The corpus pipeline: quality, language, near duplicates, mixing, packing.

Each stage reads what the stage before it kept.  ``run`` writes every stage's
result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm import langid, mixing, packing, quality, simhash
from bitquarry.llm.tables import cut, read

#: A document goes if its quality score is lower; junk scores far below, clean texts above.
LEAST_QUALITY = 0.1
#: A document goes if its stated language has a lower posterior.
LEAST_LANGUAGE = 0.001


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids (column gone); null ids stay."""
    return docs.join(gone.distinct(), docs.doc_id == gone.gone, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quadratic discriminant rejects.

    Null and empty texts are scored like any other (all statistics zero).  Rows
    that share an id go together; rows with a null id stay.  Without labels of
    both classes every score is 0.5 and all stay.  An empty table stays empty.
    """
    scores = quality.score(docs, read(spark, sf_dir, "labels"))
    return _without(docs, scores.where(F.col("score") < LEAST_QUALITY).select(F.col("doc_id").alias("gone")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are surely not in the language that they state.

    Documents without a stated language, or with a code that is none, stay.  Null
    and empty texts are judged by their source alone.  Rows that share an id go
    together; rows with a null id stay.  An empty table stays empty.
    """
    found = langid.of_documents(docs)
    return _without(docs, found.where(F.col("declared_confidence") < LEAST_LANGUAGE).select(F.col("id").alias("gone")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of copies and near copies.

    Near copies are what op5_simhash links (fingerprints within two bits, found
    by pivot tables) and texts whose sets of shingles have a Jaccard similarity
    of 0.8; groups follow links of both kinds.

    All null, empty and blank texts are copies of each other.  Rows that share an
    id stay or go together; rows with a null id stay.  An empty table stays empty.
    """
    return simhash.drop_similar(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents so that the sources meet their weights.

    A document without words stays once.  Null sources are one source.  Rows that
    share an id, null ids among them, are repeated as often as the most of them.
    An empty table stays empty.
    """
    taken = mixing.mix(docs, split=False).groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(1))).alias("copies")).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias("_mixed"), F.col("copies").cast("int").alias("_copies"))
    mixed = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_mixed"]))
    return mixed.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), taken["_copies"])).alias("_copy")).drop("_copy")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their token ids.

    Null and empty texts are one piece, the end id alone.  Repeated rows and null
    ids are each packed.  An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, hashes of tokens and near-duplicate verification have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
