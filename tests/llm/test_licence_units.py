"""Wrapped notices, lines with other words, and folders nested deeply."""

from pyspark.sql import functions as F

from bitquarry.llm import licenses
from llm.test_operators_brute_force import documents


def scanned(spark, rows):
    docs = documents(spark, [(k, t, "en", "a") for k, (t, *_) in enumerate(rows)])
    paths = spark.createDataFrame([(k, p, f) for k, (_, p, f) in enumerate(rows)], "of long, p string, is_f boolean")
    files = docs.join(paths, docs.doc_id == paths.of)
    return {r["doc_id"]: r for r in licenses.scan(files, "doc_id", "text", F.col("p"), F.col("is_f")).collect()}


def test_wrapped_notices_are_met(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met:"
    gpl = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    any later version."
    other = "The MIT library was released under the old bridge by seven sailors of the northern harbour"
    filler = [("plain words of another file " * 9, f"/x/{k}", False) for k in range(30)]
    got = scanned(spark, [(bsd, "/p/LICENSE", True), (gpl, "/q/COPYING", True), (other, "/r/a", False), ("", "/p/s/t/u/v/w", False), ("", "/q/deep/file", False), (None, None, False), *filler])
    assert got[0]["own_license"] == "BSD-3-Clause" and got[1]["own_license"] == "GPL-3.0"
    assert got[2]["own_license"] is None
    assert (got[3]["license"], got[3]["license_path"]) == ("BSD-3-Clause", "/p/LICENSE")
    assert got[4]["license"] == "GPL-3.0" and got[5]["license"] is None and got[6]["license"] is None


def test_nearest_of_several_ancestors(spark):
    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    rows = [(mit, "/a/LICENSE", True), (apache, "/a/b/c/LICENSE", True), (mit, "/a/b/c/NOTICE.b", True), ("x", "/a/b/f", False), ("x", "/a/b/c/d/e/f", False), ("x", "/z/f", False), (mit, "/z/y/own", False), ("x", "/z/y/f", False)]
    got = scanned(spark, rows)
    assert got[3]["license_path"] == "/a/LICENSE" and got[4]["license_path"].startswith("/a/b/c/") and got[5]["license"] is None
    # A notice inside a file that is no licence file is not handed down.
    assert got[6]["license"] == "MIT" and got[7]["license"] is None
