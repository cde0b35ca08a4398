"""Document quality by a regularised quadratic discriminant.

One pass over the whole texts makes a row of transformed statistics for each
document.  Labelled rows are reduced to each class's count, sums and sums of
products by a grouped aggregation, so fitting sees a fixed number of figures
however many labels there are.  Class covariances are shrunk towards their pooled
diagonal; a score is the difference of the classes' Gaussian log densities, from
Mahalanobis distances through Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitquarry.llm.tables import cut

FEATURES = ["words", "word_length", "upper", "digits", "stops", "commas", "exclaims", "bars", "symbols", "distinct", "lines", "line_repeats"]
_X = [f"x{k}" for k in range(len(FEATURES))]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?!|'-\"()")
_CLASSES = np.stack([_class(bytes(range(65, 91))), _class(bytes(range(97, 123)) + bytes(range(128, 256))), _class(b"0123456789"), _class(b".?"), _class(b",;:"), _class(b"!"), _class(b"|"), _class(_SYMBOLS)], axis=1)


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text; all zero if it has no words."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    upper, lower, digits, stops, commas, exclaims, bars, symbols = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES
    n, lines = len(words), [x for x in data.split(b"\n") if x.strip()]
    share = lambda x: float(np.log((x + 0.05 * np.sqrt(n)) / n + 0.01))  # noqa: E731  counts of few words are drawn together
    return [
        float(np.log1p(n)),
        float(np.log(sum(map(len, words)) / n)),
        float(np.sqrt((upper + 0.5) / (upper + lower + 5))),
        *map(share, (digits, stops, commas, exclaims, bars, symbols)),
        float(np.log(len(set(words)) / n) / np.log1p(n)),
        float(np.log(len(lines) / n)),
        float(np.sqrt(1 - len(set(lines)) / len(lines))),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x0, x1, ...) of each document; null texts are empty."""
    names = ["doc_id", *_X]
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.float64()) for x in _X)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([statistics(t.as_py() or "") for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, k]) for k in range(len(_X)))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join([f"{names[0]} long", *(f"{x} double" for x in _X)]))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log terms of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    terms: np.ndarray
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of class 1, in (0, 1) and increasing in the difference of log densities."""
        density = [t - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, t in zip(self.means, self.factors, self.terms)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / self.temperature, -700, 700)))


def fit(labelled: DataFrame, shrinkage: float = 0.1, floor: float = 0.001, temperature: float = 4.0) -> Discriminant | None:
    """From rows (y in 0 and 1, x0, ...); None unless both classes have rows.

    shrinkage is the part of each covariance that the pooled diagonal makes up;
    floor is added to all variances.
    """
    d, pairs = len(_X), list(combinations_with_replacement(range(len(_X)), 2))
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(_X)] + [F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {r["y"]: r for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums).where("y in (0, 1)").collect()}
    if len(rows) < 2:
        return None
    n = np.array([rows[y]["n"] for y in (0, 1)], float)
    means = np.array([[rows[y][f"s{k}"] for k in range(d)] for y in (0, 1)]) / n[:, None]
    covariances = np.zeros((2, d, d))
    for y in (0, 1):
        for i, j in pairs:
            covariances[y, i, j] = covariances[y, j, i] = rows[y][f"p{i}_{j}"] / n[y] - means[y, i] * means[y, j]
    pooled = np.diag(np.diag(np.tensordot(n / n.sum(), covariances, 1)))
    factors = np.linalg.cholesky((1 - shrinkage) * covariances + shrinkage * pooled + floor * np.eye(d))
    terms = np.log(n / n.sum()) - np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
    return Discriminant(means, np.linalg.inv(factors), terms, temperature)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document.

    Labels of held-out ids are never read by the fit.  Labels other than 0 and 1
    and those without a document are passed over.  Without rows of both classes
    every score is 0.5.  Repeated rows each give a row and count as often in the fit.
    """
    x = cut(features(docs, id_col, text_col))
    known = labels.select(F.col(label_id_col).cast("long").alias("labelled"), F.col(label_col).cast("int").alias("y")).where(~held_out(F.col("labelled")))
    model = fit(x.join(known, F.col("doc_id") == F.col("labelled")), **how)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            scores = np.full(batch.num_rows, 0.5) if model is None else model.scores(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], schema=schema)

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
