"""Near-duplicate groups where fingerprints are far apart."""

import random

import numpy as np

from bitquarry.llm import simhash
from llm.test_operators_brute_force import documents, roots


def grouped(spark, rows):
    df = documents(spark, [(k, t, "en", "a") for k, t in enumerate(rows)])
    return {r["id"]: r["group_id"] for r in simhash.similar_groups(df).collect()}


def test_all_block_edits_are_found(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(400):
        base = words(100)
        at = rng.randrange(8, 80)
        rows += [" ".join(base), " ".join([*base[:at], *words(6), *base[at + 6 :]])]
    assert 0.8 <= simhash.jaccard(rows[0], rows[1], 5) < 0.82
    got = grouped(spark, rows)
    assert got == {k: k - k % 2 for k in range(len(rows))}


def test_repeated_lines_do_not_part_copies(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for _ in range(10):
        text, line = words(150), words(10)
        rows += [f"{text} {line}", " ".join([text, *[line] * 10])]
    assert simhash.jaccard(rows[0], rows[1], 5) > 0.9
    assert grouped(spark, rows) == {k: k - k % 2 for k in range(len(rows))}


def test_parity_fingerprints_never_exceed_the_sets():
    rng = np.random.default_rng(3)
    for size in (1, 5, 80, 900):
        for edit in (0, 1, 7, 60):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            b = np.unique(np.concatenate([a[edit:], rng.integers(0, 2**63, edit).astype(np.uint64)]))
            x, y = (simhash.parity(s).view(np.uint64) for s in (a, b))
            apart = sum(int(u ^ v).bit_count() for u, v in zip(x.tolist(), y.tolist()))
            assert apart <= len(np.setxor1d(a, b))
            if len(a) == 80 and edit == 7:
                assert apart > 5


def test_a_crowd_of_near_copies_apart(spark):
    """Groups of a shingle above the limit, linked and not, against brute force; ids with several texts among them."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, rows = words(60), []
    for _ in range(60):
        x = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            x[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(x))
    df = documents(spark, [(k, t, "en", "a") for k, t in enumerate(rows)] + [(3, rows[50], "en", "a"), (59, " ".join(words(70)), "en", "a")])
    alike = [(a, b) for a in range(60) for b in range(a + 1, 60) if simhash.jaccard(rows[a], rows[b], 5) >= 0.8] + [(3, b) for b in range(60) if simhash.jaccard(rows[50], rows[b], 5) >= 0.8 and b != 3]
    want = roots(range(60), [(min(p), max(p)) for p in alike])
    assert len(set(want.values())) > 5
    for crowd in (2, 16):
        simhash._CROWD = crowd
        try:
            got = {r["id"]: r["group_id"] for r in simhash.similar_groups(df).collect()}
        finally:
            simhash._CROWD = 16
        assert {k: got.get(k, k) for k in want} == want
