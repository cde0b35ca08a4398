"""Each operator against brute force, a round trip or held-out accuracy, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from bitquarry.llm import htmltext, langid, licenses, media, mixing, packing, quality, simhash, topk, warc
from bitquarry.llm.components import components
from bitquarry.llm.licenses_sql import LICENSES
from bitquarry.llm.mixing_sql import MIX
from bitquarry.llm.queries import TOPK

SF = "/root/testdata/sf0.001"
#: Columns with names that operators use inside.
CLASHING = ["id", "fp", "size", "k", "score", "root", "gone", "_gone", "copies", "_copies", "mixed", "host", "n", "path", "node", "key", "payload", "digest", "row", "taken"]
LONG = "word salad with many different tokens " * 20000


def documents(spark, rows=None):
    """(doc_id, text, lang, source, n_chars) and clashing columns; by default awkward rows."""
    if rows is None:
        rows = [
            (1, "One plain text with several words in it. And a second sentence.", "en", "a"),
            (2, "One plain text with several words in it. And a second sentence.", "en", "a"),
            (2, "One plain text with several words in it. And a second sentence.", "en", "a"),
            (3, None, "en", "b"),
            (4, "", None, "b"),
            (5, " \t\n ", "fr", None),
            (None, "Text of a row without an id", "de", "b"),
            (6, LONG, "en", "a"),
            (7, "İstanbul – naïve 😀 <|endoftext|>\n\n  x", "en", ""),
            (8, None, None, None),
        ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(-1).alias(c) for c in CLASHING))


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql).fetchall(), [c[0] for c in con.description]


def same(df, sql, **tables):
    rows, names = duck(sql, **tables)
    show = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert Counter(map(show, df.select(*names).collect())) == Counter(map(show, rows))


# 1 -------------------------------------------------------------------------------


def test_packing_places_each_id_once(spark):
    from tokenizers import Tokenizer

    docs = documents(spark)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs.repartition(2), block_sequences=4).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        whole[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for r in docs.dropDuplicates(["doc_id"]).collect():
        want = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        own = sorted(whole[r["doc_id"]], key=lambda p: p["start"])[:: 2 if r["doc_id"] == 2 else 1]
        assert np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist() == want
        assert {p["doc_tokens"] for p in own} == {len(want)}
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    d = packing.digest(packing.pack(docs)).where("doc_id = 4").first()
    assert (d["start"], d["length"], d["ids_crc32"], d["doc_tokens"]) == (0, 1, zlib.crc32(b"\0\0\0\0"), 1)
    assert packing.pack(docs.where("false")).count() == 0


def test_packing_ids_and_padding_on_the_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    encode = packing.Encoder(packing.RANKS)
    want = t.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    assert all(np.frombuffer(a, "<u4").tolist() == b.ids for a, b in zip(encode([r["text"] or "" for r in rows]), want))
    filled = packing.pack(docs.coalesce(1)).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(1024 - r["n"] for r in filled) < 1024


def test_packing_balances_cost():
    placed = list(packing.assign([600, 500, 400, 300, 200, 48], 2, 1024, 1.0, 1 / 1024))
    assert [(p, w) for p, _, _, w in placed][:4] == [(0, 0), (1, 1), (2, 1), (3, 0)]
    assert sum(n for _, _, n, _ in placed) == 2048


# 2 -------------------------------------------------------------------------------


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING))


def test_warc_round_trip_and_revisits(spark):
    big, small = "ü" * 60, "tiny"
    df = pages(spark, [(5, "http://a/\r\nX: y", big), (3, "http://b/", big), (9, None, big), (1, "u", small), (2, "u", small), (4, None, None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 30), (8, "u", LONG)])
    read = warc.read_archives(warc.write_archives(warc.plan_revisits(df)))
    rows = {r["page_id"]: r for r in warc.page_rows(read).collect()}
    assert len(rows) == 9
    for r in df.collect():
        data = (r["html"] or "").encode()
        assert (rows[r["page_id"]]["payload_bytes"], rows[r["page_id"]]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    assert {k: r["refers_to"] for k, r in rows.items() if r["record_type"] == "revisit"} == {5: 3, 9: 3}
    assert bytes(read.where("record_id = 'urn:page:8'").first()["payload"]).decode() == LONG
    assert read.where("gap_reason is not null").count() == 0
    assert warc.page_rows(warc.read_archives(warc.write_archives(warc.plan_revisits(df.where("false"))))).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_warc_salvages_later_records(compressed):
    records = [warc.page_record(k, "u", b"payload %d" % k * 30, warc.sha256(b"payload %d" % k * 30), None) for k in range(6)]
    parts = [warc.member(r, 3) if compressed else r for r in records]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    data = bytearray(b"".join(parts))
    data[starts[2] + len(parts[2]) // 2] ^= 0x55
    data = bytes(data[: starts[5] + 20])
    found = list(warc.read_archive(data))
    kept = [x[2]["warc-record-id"] for x in found if x[2] is not None]
    gaps = [(x[0], x[1]) for x in found if x[2] is None]
    assert kept == [f"<urn:page:{k}>" for k in (0, 1, 3, 4)]
    assert gaps == [(starts[2], len(parts[2])), (starts[5], 20)]
    assert list(warc.read_archive(b"")) == []
    assert [x[2] for x in warc.read_archive(b"no archive at all")] == [None]


# 3 -------------------------------------------------------------------------------


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, labels)
    got = scored.join(labels, "doc_id").where("held_out").select("score", "quality", "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    assert auc(np.array([r["score"] for r in got]), np.array([r["quality"] for r in got])) > 0.9
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert np.allclose(key(scored), key(quality.score(docs, turned)), atol=1e-9)


def test_quality_on_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    for known in (labels, labels.where("false")):
        rows = quality.score(docs, known).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert {r["score"] for r in rows} == {0.5}
    assert quality.score(docs.where("false"), labels).count() == 0


# 4 -------------------------------------------------------------------------------


def test_language_of_pages(spark):
    p, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents"))
    found = langid.of_pages(p, docs).join(p.select(F.col("page_id").alias("id"), F.regexp_extract("url", r"//[^/]+/([a-z]{2})/", 1).alias("stated")), "id").where("stated <> ''").collect()
    assert len(found) > 100
    assert np.mean([r["lang"] == r["stated"] for r in found]) > 0.95


def test_language_on_awkward_rows(spark):
    docs = documents(spark)
    rows = langid.of_documents(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["lang"] in ("en", "fr", "de") and 0 < r["confidence"] <= 1 for r in rows)
    p = pages(spark, [(None, None, None), (1, "http://h.x/", ""), (1, "no address", "<html lang=EN-us><p>plain words of the text"), (2, "//[::", LONG)])
    assert langid.of_pages(p, docs).count() == 4
    assert {r["lang"] for r in langid.of_pages(p, docs.where("false")).collect()} == {None}
    assert langid.of_documents(docs.where("false")).count() == 0


# 5 -------------------------------------------------------------------------------


def fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("cap", [1, 32])
def test_simhash_groups(spark, cap):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(documents(spark).where("doc_id is not null").select(F.col("doc_id") + 100000, "text"))
    rows = docs.collect()
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    ids = sorted(fps)
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = simhash.groups(docs, cap=cap).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("cap", [1, 32])
def test_simhash_links_within_two_bits(spark, cap):
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(3)]
    signed = sorted({simhash._as_long(v) for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, cap)).collect()}
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert {n: got.get(n, n) for n in signed} == want


def test_similar_groups(spark):
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for size in (1, 2, 40, 150, 150, 1500):
        base = words(size)
        rows.append(" ".join(base))
        for _ in range(4):
            x = list(base)
            for _ in range(rng.randrange(1 + size // 40)):
                x[rng.randrange(size)] = "changed"
            rows.append(" ".join(x))
    rows += [None, "", "  ", rows[0].upper()] + [" ".join(words(100)) for _ in range(20)]
    df = documents(spark, [(k, t, "en", "a") for k, t in enumerate(rows)] + [(None, rows[0], "en", "a")])
    want = roots(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if simhash.jaccard(rows[a], rows[b], 5) >= 0.8])
    got = {r["id"]: r["group_id"] for r in simhash.similar_groups(df).collect()}
    assert {k: got.get(k, k) for k in want} == want
    kept = simhash.drop_similar(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {*want.values(), None}
    assert simhash.similar_groups(df.where("false")).count() == 0
    assert simhash.groups(df.where("false")).count() == 0


# 6 -------------------------------------------------------------------------------


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("x" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 30, 200]))), "en", rng.choice(["a", "a", "a", "a", "b", "c", None])) for k in range(400)]
    docs = documents(spark, [*rows, (400, None, None, None), (401, LONG, None, "a"), (402, "p q r", None, "é")])
    got = mixing.mix(docs).collect()
    assert Counter(got) == Counter(mixing.mix(docs).collect())
    sums, targets = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"], r["source_size"]
    assert sum(t for t, _ in targets.values()) == pytest.approx(sum(s for _, s in targets.values()))
    for s, (t, n) in targets.items():
        assert t <= 3 * n + 1e-6 and abs(sums[s] - t) <= 2
    same(mixing.mix(docs).drop("source"), MIX, documents=docs)
    awkward = documents(spark)
    assert mixing.mix(awkward).count() == awkward.count()
    assert mixing.mix(awkward.where("false")).count() == 0


# 7 -------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(k, [float(x) for x in np.round(centres[k % 6] + rng.normal(size=8) * 0.2, 2)]) for k in range(700)]
    rows[101] = (101, rows[100][1])
    rows[350] = (350, rows[100][1])
    rows += [(800, None), (850, [1.0, None] + [0.0] * 6), (900, [float("nan")] + [0.0] * 7), (950, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("id"), F.lit(2).alias("v"), F.lit(3).alias("dim"))
    got = topk.top_k(df, query_block=5, block=100, least_cells=3)
    same(got, TOPK, embeddings=df)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert topk.top_k(few).count() == 2
    assert topk.top_k(few.union(few)).count() == 2
    assert topk.top_k(df.where("false")).count() == 0


def test_dual_tree_prunes():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(40, 6))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 6)) * 0.01))
    s = topk.Search(np.arange(400), x[:400], np.arange(4000), x, 5).run()
    exact = np.sort(np.where(np.arange(400)[:, None] == np.arange(4000)[None, :], -np.inf, x[:400] @ x.T), axis=1)[:, :-6:-1]
    assert np.array_equal(s.scores, exact)
    assert s.pairs < 400 * 4000 * 0.75


# 8 -------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("shape", [(1, 1), (7, 576), (40, 33)])
def test_png_round_trip(kind, shape):
    image = np.random.default_rng(6).integers(0, 256, shape, dtype=np.uint8)
    data = media.encode_png(image.tobytes(), shape[1], kind=kind, chunk_bytes=500)
    assert np.array_equal(media.decode_png(data), image)
    bad = bytearray(data)
    bad[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(data[:-5])


def test_media_features(spark):
    docs = documents(spark)
    rows = media.features(media.encode(docs)).collect()
    texts = Counter()
    for r in docs.collect():
        data = (r["text"] or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        texts[r["doc_id"], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == texts
    assert all(r["error"] is None and len(r["feature"]) == 16 for r in rows)
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (1, 2)}) == 1
    bad = spark.createDataFrame([(1, 2, b"no image"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["error"] and r["feature"] is None for r in media.features(bad).collect())
    assert media.features(media.encode(docs.where("false"))).count() == 0


def test_cosine_hash_changes_little_under_small_edits():
    image = np.random.default_rng(7).integers(0, 256, (64, 64)).cumsum(0).astype(np.uint8)
    other = image.copy()
    other[3, 5] ^= 255
    assert (int(media.cosine_hash(image), 16) ^ int(media.cosine_hash(other), 16)).bit_count() <= 4


# 9 -------------------------------------------------------------------------------

PROSE = "The article goes on for a while, with sentences that are long enough to count as prose. "


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("plain text only", "plain text only"),
        (f"<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li>Home</li></ul></nav><article><h1>Title</h1><p><b>{PROSE}<br><p>Short &amp; sweet.</article><aside>{PROSE}</aside><footer>&copy;</footer></body></html>", f"Title {PROSE}Short & sweet."),
        (f"<body><div class='menu'><a>One</a> <a>Two</a></div><div id=content><p>{PROSE}</p><p>{PROSE}</p></div><div class=comments><p>{PROSE}</p></div><div class='cookie-notice'>{PROSE}</div></body>", f"{PROSE}{PROSE}".strip()),
        (f"<article><header><h1>Head</h1></header><p>{PROSE}</p><form><label>Mail</label></form><style>p{{}}</style><p>a\n\t b&nbsp;c</p><!-- <p>no</p> --></article>", f"Head {PROSE}a b c"),
        ("<article><p>cut off", "cut off"),
        ("<article><p>1 < 2 &lt;b&gt; &#x41;</p></article>", "1 < 2 <b> A"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_html_rows(spark):
    p = pages(spark, [(1, "u", None), (None, None, f"<p>{PROSE}"), (2, "u", "<article><p>" + LONG), (2, "u", "<article><p>" + LONG)])
    rows = htmltext.extract(p).collect()
    assert Counter((r["page_id"], r["n_chars"]) for r in rows) == Counter([(1, 0), (None, len(PROSE) - 1), (2, len(LONG) - 1), (2, len(LONG) - 1)])
    assert htmltext.extract(p.where("false")).count() == 0


# 10 ------------------------------------------------------------------------------


def test_licences(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "en", "a"),
        (2, "Released under the MIT License", "en", "a"),
        (3, "more words " * 80, "en", "a"),
        (4, "some code\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files\nmore", "en", "b"),
        (5, "more words " * 80 + "\nSPDX-License-Identifier: MIT", "en", "b"),
        (6, None, None, None),
        (7, "", "en", "c"),
        (8, "All rights reserved. " * 3000, "en", "c"),
        (9, "more words " * 80, "en", "c"),
        (2, "Released under the MIT License", "en", "a"),
    ]
    docs = documents(spark, rows)
    path, short = licenses.document_layout(*map(F.col, ("text", "source", "lang", "doc_id")))
    found = licenses.scan(docs, "doc_id", "text", path, short)
    same(found, LICENSES, documents=docs)
    got = {r["doc_id"]: (r["own_license"], r["license"], r["license_path"]) for r in found.collect()}
    assert got[1][0] == "Apache-2.0" and got[2][0] == "MIT" and got[4][0] == "MIT" and got[5][0] == "MIT" and got[8][0] == "Proprietary"
    assert got[3][0] is None and got[3][1] in ("Apache-2.0", "MIT") and got[9] == (None, None, None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.scan(docs.where("false"), "doc_id", "text", path, short).count() == 0
