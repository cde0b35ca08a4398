"""Licence scans: sparse TF-IDF cosine to templates, inheritance from the nearest ancestor folder.

DataFrame operations only.  A file's units are its lines and sentences, and two
and three of them in a row, so that a notice that is wrapped over lines is met as
a whole.  Document frequencies of the templates' terms are counted over all
files.  A unit can only reach the threshold if it has a term that carries enough
of some template's weight (Cauchy and Schwarz), so units without any such term
are passed over without a loss; the others are compared with every template that
shares a term, the document frequencies of their own terms being counted over
all files too.  A file without a notice of its own takes the licence of the
licence file in its folder or, failing that, in the nearest folder above.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitquarry.llm.tables import checked, cut

#: (licence, notice or opening of the licence file).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Proprietary", "All rights reserved"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
]
TERM_BREAK = r"[^a-z0-9]+"
UNIT_BREAK = r"\n|(?<=[.!?;])[ \t]+"


def terms(text: str) -> list[str]:
    return [t for t in re.split(TERM_BREAK, text.lower()) if t]


def idf(files: float, with_term: float) -> float:
    return math.log((1 + files) / (1 + with_term)) + 1


def vectors(weights: dict[str, float], templates: list[tuple[str, str]]) -> list[dict[str, float]]:
    """The templates' unit vectors."""
    out = []
    for _, text in templates:
        v = {t: terms(text).count(t) * weights[t] for t in terms(text)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def anchors(weights: dict[str, float], templates: list[tuple[str, str]], least: float) -> list[str]:
    """Terms of which any unit within the threshold of a template has at least one.

    The commonest terms are left out as long as no template has a share of
    least ** 2 of its squared weight in them.
    """
    own, out, left_out = vectors(weights, templates), set(), set()
    for t in sorted(weights, key=lambda t: (weights[t], t)):
        if max(sum(v.get(x, 0) ** 2 for x in left_out | {t}) for v in own) < least * least * 0.999:
            left_out.add(t)
        else:
            out.add(t)
    return sorted(out)


def _terms(c: Column) -> Column:
    return F.split(F.lower(c), TERM_BREAK)


def scan(files: DataFrame, id_col: str, text_col: str, path: Column, is_licence_file: Column, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.75) -> DataFrame:
    """(doc_id, path, own_license, similarity, license, license_path) of each file.

    own_license is that of the unit most similar to a template, at or above
    ``least``; ties go to the first template.  An empty table gives no rows.  license is that or the inherited
    one, license_path the file that it comes from.  Of several licence files in
    a folder the most similar counts, then the smallest path.  Null and empty
    texts have no notice; a null path has no folder.  Rows with equal ids each
    give a row.  The templates, their terms and frequencies are the only data on
    the driver.
    """
    f = files.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), path.alias("path"), is_licence_file.alias("is_file"))
    vocabulary = sorted({t for _, text in templates for t in terms(text)})
    has = f.select(F.explode(F.array_intersect(_terms(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("term"))
    counts = {r["term"]: r["n"] for r in has.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = f.count()
    weights = {t: idf(total, counts.get(t, 0)) for t in vocabulary}
    words = "|".join(map(re.escape, anchors(weights, templates, least)))
    sign = rf"(?:^|[^a-z0-9])(?:{words})(?:[^a-z0-9]|$)"
    lines = F.split("text", UNIT_BREAK)
    slim = f.withColumn("lines", F.when(F.lower("text").rlike(sign), lines))
    joined = lambda k, n: F.when(k + n <= F.size("lines"), F.array_join(F.slice("lines", k + 1, n), " "))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: F.array(joined(k, 1), joined(k, 2), joined(k, 3))))
    slim = slim.withColumn("units", F.when(F.col("lines").isNotNull(), F.filter(runs, lambda u: F.lower(u).rlike(sign))))
    slim = cut(slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", "is_file", "units"))
    tf = cut(slim.select("row", F.posexplode("units").alias("unit", "line")).select("row", "unit", F.explode(_terms(F.col("line"))).alias("term")).where("term <> ''").groupBy("row", "unit", "term").agg(F.count(F.lit(1)).alias("n")))
    others = checked(cut(tf.select("term").distinct().where(~F.col("term").isin(vocabulary))))
    in_files = f.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(others, "term").groupBy("term").agg(F.count(F.lit(1)).alias("files"))
    in_files = cut(in_files.select("term", (F.log(F.lit(1.0 + total) / (F.lit(1.0) + F.col("files"))) + 1).alias("weight")))
    own = _best(tf, in_files, weights, templates, least)
    named = slim.drop("units").join(own, "row", "left")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    named = named.withColumn("folder", folder)
    given = named.where("is_file and own_license is not null and folder is not null").groupBy("folder").agg(F.min(F.struct((-F.col("similarity")).alias("order"), "path", "own_license")).alias("x")).select(F.col("folder").alias("giver"), F.col("x.own_license").alias("given"), F.col("x.path").alias("given_path"))
    # One row a folder, then one for each folder above it.
    above = named.where("folder is not null").select("folder").distinct().withColumn("parts", F.split("folder", "/"))
    above = above.select("folder", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").select("folder", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("upper"))
    nearest = above.join(given, F.col("upper") == F.col("giver")).groupBy("folder").agg(F.max(F.struct("depth", "given", "given_path")).alias("x")).select(F.col("folder").alias("heir"), F.col("x.given").alias("given"), F.col("x.given_path").alias("given_path"))
    out = named.join(nearest, F.col("folder") == F.col("heir"), "left")
    return out.select("doc_id", "path", "own_license", "similarity", F.coalesce("own_license", "given").alias("license"), F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("given_path")).alias("license_path"))


def _best(tf: DataFrame, others: DataFrame, weights: dict[str, float], templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(row, own_license, similarity) of rows with a unit at or above the threshold.

    tf has the terms (row, unit, term, n) of units, others the weights of terms
    that no template has.
    """
    spark = tf.sparkSession
    entries = [(k, name, t, w) for k, ((name, _), v) in enumerate(zip(templates, vectors(weights, templates))) for t, w in v.items()]
    template = F.broadcast(spark.createDataFrame(entries, "template int, license string, term string, share double"))
    weight = F.broadcast(spark.createDataFrame(sorted(weights.items()), "term string, known double"))
    weighed = tf.join(weight, "term", "left").join(checked(others), "term", "left").withColumn("x", F.col("n") * F.coalesce("known", "weight"))
    norms = weighed.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(template, "term").groupBy("row", "unit", "template", "license").agg(F.sum(F.col("x") * F.col("share")).alias("dot"))
    scored = dots.join(norms, ["row", "unit"]).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= least)
    return scored.groupBy("row").agg(F.max(F.struct("similarity", (-F.col("template")).alias("order"), "license")).alias("x")).select("row", F.col("x.license").alias("own_license"), F.col("x.similarity").alias("similarity"))


def document_layout(text: Column, source: Column, lang: Column, doc_id: Column) -> tuple[Column, Column]:
    """(path, is_licence_file) of documents laid out as files in nested folders.

    A document of up to 60 words is a licence file if it has a notice; it stands
    in /source/lang, or with an odd id in the folder of its length class there.  A
    longer one stands a level below the folder of its length class.
    """
    n = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    folder = F.concat(F.lit("/"), F.coalesce(source, F.lit("")), F.lit("/"), F.coalesce(lang, F.lit("")))
    size, short, key = F.length(F.bin(n)).cast("string"), n <= 60, F.coalesce(doc_id, F.lit(0))
    below = F.when(short & (key % 2 == 0), "").when(short, F.concat(F.lit("/"), size)).otherwise(F.concat(F.lit("/"), size, F.lit("/"), (key % 5).cast("string")))
    return F.concat(folder, below, F.lit("/"), F.coalesce(doc_id.cast("string"), F.lit("null"))), short
