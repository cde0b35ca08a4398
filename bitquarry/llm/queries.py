"""The operators' registered queries, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm import htmltext, langid, licenses, media, mixing, packing, quality, simhash, topk, warc
from bitquarry.llm.licenses_sql import LICENSES
from bitquarry.llm.mixing_sql import MIX
from bitquarry.llm.tables import cut, read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens; one row a piece."""
    return packing.digest(packing.pack(read(spark, sf_dir, "documents")))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives into the shared folder and read back."""
    archives = cut(warc.write_archives(warc.plan_revisits(read(spark, sf_dir, "pages"))), "none")
    return warc.page_rows(warc.read_archives(archives, with_payload=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; labels of held-out ids are not learned from."""
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page."""
    found = langid.of_pages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("page_id"), "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "host")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their groups at two or fewer differing bits."""
    return simhash.groups(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to the weights 1, 2, 3, repeating."""
    return mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a PNG column, stored, read back and decoded, with its cosine-transform hash."""
    return media.features(cut(media.encode(read(spark, sf_dir, "documents")), "none")).drop("error")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents, laid out as files, and what folders hand down."""
    path, short = licenses.document_layout(*map(F.col, ("text", "source", "lang", "doc_id")))
    return licenses.scan(read(spark, sf_dir, "documents"), "doc_id", "text", path, short)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_langid": op4_langid,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_topk": op7_topk,
    "op8_media": op8_media,
    "op9_html": op9_html,
    "op10_licenses": op10_licenses,
}

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {
    "op6_mixing": MIX,
    "op7_topk": TOPK,
    "op10_licenses": LICENSES,
}
