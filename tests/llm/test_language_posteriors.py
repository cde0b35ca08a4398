"""Posteriors against brute force, many languages, markup that is hard to read."""

import random
import time

import numpy as np
import pyarrow.parquet as pq

from bitquarry.llm import htmltext, langid
from llm.test_operators_brute_force import documents, pages


def brute(rows, names, logs, strength=8.0, most_evidence=40.0):
    """rows: (host, domain, suffix, declared, text); the posteriors of each, a dense array."""
    lk, own = [], []
    for *_, text in rows:
        c = langid.trigrams(text)
        n = c.sum()
        l = logs @ c * min(1, most_evidence / n) if n else np.zeros(len(names))
        l = l - l.max()
        lk.append(l)
        own.append(np.round(np.exp(l) / np.exp(l).sum(), 6) if n else np.zeros(len(names)))
    own = np.array(own)
    total = own.sum(0)
    base = (total + 1) / (total.sum() + len(names))
    out = []
    for n, (host, domain, suffix, declared, _) in enumerate(rows):
        at = lambda k, v: own[[m for m, r in enumerate(rows) if r[k] == v]].sum(0)
        d, u, h = at(1, domain), at(2, suffix), at(0, host) - own[n]
        domain_prior = (d + strength * base) / (d.sum() + strength)
        suffix_ratio = (u + strength * base) / (u.sum() + strength) / base
        host_prior = (np.maximum(h, 0) + strength * domain_prior) / (max(h.sum(), 0) + strength)
        c = at(3, declared)
        chance = (0.9 * c + 0.1 * base * c.sum()) / (base * max(1, total.sum())) if declared is not None and c.sum() > 0 else np.ones(len(names))
        log = lk[n] + np.log(chance + 1e-12) + np.log(suffix_ratio) + np.log(host_prior)
        p = np.exp(log - log.max())
        out.append(p / p.sum())
    return np.array(out)


def test_posteriors_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, logs = langid.train(docs)
    assert names == sorted({r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"]})
    counts = {n: sum((langid.trigrams(r["text"] or "") for r in docs.where(f"lang = '{n}'").collect()), np.zeros(8192)) + 0.5 for n in names}
    assert np.allclose(logs, [np.log(counts[n] / counts[n].sum()) for n in names])
    table = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    table += [{"page_id": 9000 + k, "url": u, "html": h} for k, (u, h) in enumerate([(table[0]["url"], None), (None, ""), ("http://de.new.example/", "<html lang=de><p>"), ("//x.y.z.example.fr/", "<p>the and of to in")])]
    p = pages(spark, [(r["page_id"], r["url"], r["html"]) for r in table])
    host, domain, suffix = langid.address_parts(p["url"])
    keys = {r["page_id"]: (r["h"], r["d"], r["s"], r["l"]) for r in p.select("page_id", host.alias("h"), domain.alias("d"), suffix.alias("s"), langid.markup_language(p["html"]).alias("l")).collect()}
    want = brute([(*keys[r["page_id"]], htmltext.without_markup(r["html"] or "")) for r in table], names, logs)
    got = {r["id"]: r for r in langid.of_pages(p, docs).collect()}
    for r, post in zip(table, want):
        g = got[r["page_id"]]
        assert abs(g["confidence"] - post.max()) < 1e-6, r["url"]
        assert abs(post[names.index(g["lang"])] - post.max()) < 1e-9
        if g["declared"] in names:
            assert abs(g["declared_confidence"] - post[names.index(g["declared"])]) < 1e-6


def test_more_languages_than_sixty_four(spark):
    """Each language has words of its own; codes with regions and capitals are the same language."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    langs = [a + b for a in letters[:10] for b in letters[:9]]
    words = {x: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)] for x in langs}
    text = lambda x: " ".join(rng.choice(words[x]) for _ in range(40))
    rows = [(k, text(x), x if k % 2 else x.upper() + "-XX", "src") for k, x in enumerate(langs * 3)]
    rows += [(5000, text("ab"), "unknown code", "src"), (5001, None, "cd", "src"), (5002, "", None, None)]
    names, _ = langid.train(documents(spark, rows))
    assert names == langs
    got = {r["id"]: r for r in langid.of_documents(documents(spark, rows)).collect()}
    assert sum(got[k]["lang"] == x for k, x in enumerate(langs * 3)) >= 0.98 * 270
    assert got[5000]["lang"] == "ab" and got[5000]["declared"] is None and got[5000]["declared_confidence"] is None
    assert got[5001]["text_lang"] is None and got[5001]["lang"] == "cd" and got[5002]["lang"] in langs
    assert abs(sum(got[k]["confidence"] for k in got) / len(got)) <= 1


def test_markup_is_read_in_linear_time():
    assert htmltext.without_markup("<p>caf&eacute; &amp; th&#233;<script>no</script>").split() == ["café", "&", "thé"]
    began = time.process_time()
    htmltext.without_markup("<script>x" * 60_000)
    htmltext.without_markup("<!-- x" * 60_000)
    assert time.process_time() - began < 5
