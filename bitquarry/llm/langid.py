"""Language identification by Bayesian evidence fusion.

Four pieces of evidence about a document are multiplied: the likelihood of its
text under byte-trigram models, the chance that its language is declared as its
markup says, the likelihood of its address's suffix, and a prior for its host.
Text models are grouped counts over all documents with a stated language.  The
other three come from grouped sums of the text's own posteriors: a declaration
table, a suffix table, and host priors that are smoothed towards the host's
domain, which is smoothed towards all rows.  A row's own part is taken out of
its host's sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitquarry.llm.htmltext import without_markup
from bitquarry.llm.tables import checked, cut, slices

_CELLS = 8192
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_LOWER[[*range(9, 14), *range(33, 65), *range(91, 97), *range(123, 127)]] = 32


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text, letters lowered, all else as spaces."""
    x = _LOWER[np.frombuffer(f" {text} ".encode(), np.uint8)]
    cells = (x[:-2] * 40503 + x[1:-1] * 299 + x[2:] * 7) % _CELLS
    return np.bincount(cells[(x[1:-1] != 32) | (x[:-2] != 32) & (x[2:] != 32)], minlength=_CELLS)


def primary(c: Column) -> Column:
    """The primary part (two or three letters) of a language code, lower case; null where there is none."""
    found = F.regexp_extract(F.lower(F.trim(c.cast("string"))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found)


def _summed(parts: DataFrame) -> DataFrame:
    """Rows (lang, counts) with the counts of each task's rows of a language added, one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(x.as_py(), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "counts"])

    return parts.select("lang", "counts").mapInArrow(run, "lang string, counts binary")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities): counts by language over all rows that state one.

    Languages are the primary parts of the codes, all that occur.  Each task sums
    its rows, two shuffles of such sums add them, and one row for each language
    reaches the driver: 64 kB, where codes of two or three letters can name many
    but not any number of languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "counts"])
            sums.clear()
            return done

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in sums and len(sums) >= 256:
                    yield out()
                sums[lang] = sums.get(lang, 0) + trigrams(text.as_py() or "")
        if sums:
            yield out()

    stated = docs.select(primary(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    parts = stated.mapInArrow(run, "lang string, counts binary").withColumn("salt", F.spark_partition_id() % 32)
    rows = _summed(_summed(parts.repartition("lang", "salt")).repartition("lang")).orderBy("lang").collect()
    if not rows:
        return [], np.zeros((0, _CELLS))
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in rows]) + 0.5
    return [r["lang"] for r in rows], np.log(counts / counts.sum(1, keepdims=True))


#: Languages whose text likelihood lies below the best one's by more are left out of a row: no prior makes up for that.
_MARGIN = 100.0


def likelihoods(counts: np.ndarray, logs: np.ndarray, most_evidence: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(languages, log likelihoods with the best at 0, posteriors to six places) of a text; empty without trigrams."""
    n = counts.sum()
    if not n:
        return np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
    l = logs @ counts * min(1.0, most_evidence / n)  # noqa: E741
    l -= l.max()
    t = np.exp(l)
    k = np.flatnonzero(l >= -_MARGIN)
    return k.astype(np.int32), l[k], np.round(t[k] / t.sum(), 6)


def text_likelihoods(rows: DataFrame, text: Column, keep: list[str], model: tuple[list[str], np.ndarray], read=None, most_evidence: float = 40.0) -> DataFrame:
    """The columns to keep, and the arrays langs, l and t of likelihoods().

    ``most_evidence`` is the temperature of texts: one counts as at most so many
    independent trigrams, so that long ones do not outvote everything.  read
    turns the raw text into the text to judge.
    """
    known = rows.sparkSession.sparkContext.broadcast(model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                found = [likelihoods(trigrams(read(t) if read else t), known.value, most_evidence) for t in (x.as_py() or "" for x in part.column(part.num_columns - 1))]
                ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
                arrays = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=[*keep, "langs", "l", "t"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, text.cast("string").alias("_text")).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["langs array<int>", "l array<double>", "t array<double>"]))


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) > 3, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(host)
    return host, domain, F.element_at(labels, -1)


def markup_language(html: Column) -> Column:
    """The primary language that the html element declares, lower case; null without one."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def _maps(sums: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name: language -> sum, name_n: their total) of rows (key, k, s)."""
    each = sums.groupBy(key, "k").agg(F.sum("s").alias("s")).groupBy(key)
    return each.agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias(name), F.sum("s").alias(f"{name}_n"))


def fuse(rows: DataFrame, names: list[str], strength: float = 8.0) -> DataFrame:
    """rows (id, host, domain, suffix, declared, langs, l, t) with idx (languages) and p (their posteriors).

    The text's own posteriors t are summed by host, domain, suffix, declaration
    and over all rows; a key's sums are a map with an entry for each language at
    most, made from rows of key and language, so that no task gathers a hot key.
    The rows are read several times, so they should be a written table; null
    hosts, domains and suffixes are keys of their own.
    """
    each = rows.select("host", "domain", "suffix", "declared", F.explode(F.arrays_zip("langs", "t")).alias("x")).select("host", "domain", "suffix", "declared", F.col("x.langs").alias("k"), F.col("x.t").alias("s")).where("s > 0")
    hosts = cut(each.groupBy("host", "domain", "suffix", "k").agg(F.sum("s").alias("s")))
    total = {r["k"]: r["s"] for r in hosts.groupBy("k").agg(F.sum("s").alias("s")).collect()}
    everything = sum(total.values())
    base = F.array(*(F.lit((total.get(k, 0.0) + 1.0) / (everything + len(names))) for k in range(len(names))))
    of = cut(rows.select("host", "domain", "suffix").distinct())
    for key, name in (("host", "hm"), ("domain", "dm"), ("suffix", "um")):
        m = cut(_maps(hosts, key, name)).withColumnRenamed(key, f"_{name}")
        of = of.join(checked(m), of[key].eqNullSafe(m[f"_{name}"]), "left").drop(f"_{name}")
    of = cut(of.select(F.col("host").alias("_host"), F.col("domain").alias("_domain"), F.col("suffix").alias("_suffix"), "hm", "hm_n", "dm", "dm_n", "um", "um_n"))
    said = cut(_maps(each.where("declared is not null"), "declared", "cm")).withColumnRenamed("declared", "_declared")
    joined = rows.join(checked(of), rows.host.eqNullSafe(of._host) & rows.domain.eqNullSafe(of._domain) & rows.suffix.eqNullSafe(of._suffix)).drop("_host", "_domain", "_suffix")
    joined = joined.join(checked(said), F.col("declared") == F.col("_declared"), "left")
    some = F.size("langs") > 0
    every = F.sequence(F.lit(0), F.lit(len(names) - 1))
    zero = F.array_repeat(F.lit(0.0), len(names))
    joined = joined.withColumn("idx", F.when(some, F.col("langs")).otherwise(every)).withColumn("_own", F.aggregate("t", F.lit(0.0), lambda a, x: a + x))
    joined = joined.withColumn("_l", F.when(some, F.col("l")).otherwise(zero)).withColumn("_t", F.when(some, F.col("t")).otherwise(zero)).withColumn("_z", F.arrays_zip("idx", "_l", "_t"))

    def get(m: str, k: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0))

    n = lambda m: F.coalesce(F.col(f"{m}_n"), F.lit(0.0))

    def log_posterior(x: Column) -> Column:
        k = x["idx"]
        own = F.element_at(base, k + 1)
        domain = (get("dm", k) + strength * own) / (n("dm") + strength)
        suffix = (get("um", k) + strength * own) / (n("um") + strength) / own
        # A row's own part is taken out of its host's sums.
        host = (F.greatest(get("hm", k) - x["_t"], F.lit(0.0)) + strength * domain) / (F.greatest(n("hm") - F.col("_own"), F.lit(0.0)) + strength)
        # The chance of this declaration under each language, a tenth of it shared by all declarations alike.
        chance = F.when(F.col("cm").isNull(), F.lit(1.0)).otherwise((0.9 * get("cm", k) + 0.1 * own * n("cm")) / (own * max(1.0, everything)))
        return x["_l"] + F.log(chance + 1e-12) + F.log(suffix) + F.log(host)

    joined = joined.withColumn("_logs", F.transform("_z", log_posterior))
    joined = joined.withColumn("_e", F.transform("_logs", lambda x: F.exp(x - F.array_max("_logs"))))
    joined = joined.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return joined.withColumn("p", F.transform("_e", lambda x: x / F.col("_sum"))).select(*rows.columns, "idx", "p")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], read=None, strength: float = 8.0) -> DataFrame:
    """(id, lang, confidence, text_lang, declared, declared_confidence, host) of rows (id, text, host, domain, suffix, declared).

    declared_confidence is the posterior of the declared language, null if it
    is none of the model's.  Null and empty texts leave the decision to the
    other evidence and have no text_lang; of equal posteriors the first language
    by name counts.  Without a model lang is null and confidence 0.  Null and
    repeated ids each give a row; an empty table gives none.
    """
    names = model[0]
    if not names:
        none = lambda t: F.lit(None).cast(t)
        return rows.select("id", none("string").alias("lang"), F.lit(0.0).alias("confidence"), none("string").alias("text_lang"), "declared", none("double").alias("declared_confidence"), "host")
    slim = cut(text_likelihoods(rows, F.col("text"), ["id", "host", "domain", "suffix", "declared"], model, read))
    fused = fuse(slim, names, strength)
    name = F.array(*map(F.lit, names))
    best = lambda values, of: F.element_at(name, F.element_at(of, F.array_position(values, F.array_max(values)).cast("int")) + 1)
    stated = F.array_position(name, F.col("declared"))
    place = F.array_position("idx", (stated - 1).cast("int"))
    sure = F.when(stated > 0, F.when(place > 0, F.element_at("p", place.cast("int"))).otherwise(F.lit(0.0)))
    text_lang = F.when(F.size("t") > 0, best(F.col("t"), F.col("langs")))
    return fused.select("id", best(F.col("p"), F.col("idx")).alias("lang"), F.array_max("p").alias("confidence"), text_lang.alias("text_lang"), "declared", sure.alias("declared_confidence"), "host")


def of_pages(pages: DataFrame, documents: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """identify() for web pages, with text models of documents."""
    host, domain, suffix = address_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("text"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), markup_language(F.col(html_col)).alias("declared"))
    return identify(rows, train(documents), without_markup)


def of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """identify() for documents: the source stands for the host, the lang column for the declaration."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), source.alias("host"), source.alias("domain"), F.lit("").alias("suffix"), primary(F.col(lang_col)).alias("declared"))
    return identify(rows, train(docs, text_col, lang_col))
