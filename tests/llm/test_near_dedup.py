import random

import numpy as np
import pyarrow as pa
import pytest

from prosemill.llm.common import Words, components
from prosemill.llm.near_dedup import near_duplicates, superminhash

SCHEMA = "doc_id long, text string"


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]


def shingles(t, n):
    w = words(t)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def brute(rows, n, percent=80):
    sets = {d: shingles(t, n) for d, t in rows}
    at = {d: d for d in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("n", [4, 5])
def test_as_brute_force(spark, n):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 60, 200]))]
        for _ in range(8):
            t = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3, len(t) // 15])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows) + 100, " ".join(t)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one\x0b"), (6, "ÀB c d"), (7, "Àb C D")]
    rng.shuffle(rows)
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA), n)) == brute(rows, n)


def test_sf_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_duplicates(docs, 4)) == brute(rows, 4)


def test_nulls_repeats_empty_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(None, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "a b c d e f", 3), (9, None, None), (8, "x " * 30_000, 4)],
        "doc_id long, text string, DOC_ID long",
    )
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 5).collect())
    assert rows == [(0, 2, None, True), (7, 2, 7, True), (7, 2, 7, True), (8, 1, 8, True), (9, 0, 9, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    a, b = pool[:1000], pool[200:]
    h = superminhash(np.concatenate((a, b)), np.array([0, 1000, 2000]), 96)
    assert abs((h[0] == h[1]).mean() - 800 / 1200) < 0.15
    one = superminhash(pool[:1], np.array([0, 1]), 96)
    assert sorted((one[0] >> np.uint64(48)).tolist()) == list(range(96))


def test_words_follow_the_pattern():
    texts = ["A  b\tc", None, "", "é x\x0c Y", "end "]
    w = Words(pa.array(texts))
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    same = Words(pa.array(["a B", "b A c"]))
    assert same.hash[0] == same.hash[3] and same.hash[1] == same.hash[2]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 103)}


def test_blocks_of_large_groups(spark, monkeypatch):
    from prosemill.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            t[rng.randrange(len(t))] = f"w{rng.randrange(500)}"
        rows.append((i, " ".join(t)))
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA), 4)) == brute(rows, 4)


def test_groups_that_meet_late(spark, monkeypatch):
    """Chains whose ends are not linked, in blocks of a few classes or shingles."""
    from prosemill.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    rng = random.Random(14)
    rows = []
    for _ in range(4):
        t = [f"w{rng.randrange(900)}" for _ in range(90)]
        for i in range(25):
            rows.append((rng.randrange(10**9), " ".join(t)))
            t = list(t)
            for _ in range(rng.choice([1, 1, 2])):
                t[rng.randrange(len(t))] = f"w{rng.randrange(900)}"
    want = brute(rows, 4)
    assert len({c for _, c, _ in want.values()}) < 30
    assert got(near_duplicates(spark.createDataFrame(rows, SCHEMA), 4)) == want


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    x, y, z = text(), text(), text()
    rows = [(0, x), (1, x + " more"), (1, y), (1, y), (5, y + " more"), (7, z), (7, z + " more"), (8, None), (8, z), (9, None), (None, x), (-4, "other words")]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA), 4).collect()
    by = {}
    hashes = {r.t: r.h for r in spark.createDataFrame(rows, SCHEMA).selectExpr("text t", "xxhash64(text) h").collect()}
    for r in found:
        by.setdefault((r.doc_id, r.row), set()).add((r.component_id, r.kept, r.first))
    assert len(found) == len(rows) and all(len(v) == 1 for v in by.values())
    at = lambda d, t: by[d, hashes[t]].copy().pop()
    assert at(0, x) == (0, True, True) and at(1, x + " more") == (0, False, False)
    assert at(1, y) == (1, True, True) and at(5, y + " more") == (1, False, False)
    assert {at(7, z), at(7, z + " more")} == {(7, True, True), (7, True, False)} and at(8, z) == (7, False, False)
    assert at(8, None) == (8, True, True) and at(9, None) == (9, True, True) and at(-4, "other words") == (-4, True, True)
    assert at(None, x) == (None, True, True)


def test_a_hub_has_many_neighbours(spark):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 3000)] + [(rng.randrange(1, 3000), 5000 + i) for i in range(500)]
    rng.shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(found.values()) == {0} and len(found) == 3500
