import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.llm import ann_forest
from prosemill.llm.ann_forest import nearest


def brute(ids, x, k=20, every=20):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            score = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "SHARD", 1500)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3000:3200] = x[5]  # many equal vectors
    ids = np.arange(4000)
    want = brute(ids, x.astype(np.float64))
    got = answers(nearest(table(spark, ids, x)))
    assert set(got) == set(want) and all(len(a) == 20 for a in got.values())
    assert recall(got, want) >= 0.9
    exact = x.astype(np.float64)
    assert all(abs(s - exact[q] @ exact[i]) < 1e-12 for q, a in got.items() for i, s in a)
    assert got[3000] == want[3000]


def test_test_tables(spark, small):
    for path in (small, "/root/testdata/sf0.1"):
        df = spark.read.parquet(f"{path}/embeddings.parquet")
        rows = df.collect()
        ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
        assert recall(answers(nearest(df)), brute(ids, x)) >= 0.9


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_forest_chooses_few_candidates(spark, sf):
    """No size is searched by brute force."""
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    forest, least = ann_forest.Forest(x), max(ann_forest.TIMES_K * 20, int(ann_forest.SHARE * len(x))) + 1
    share = [len(c) / len(x) for c in forest.candidates(x[::20], least)]
    assert max(share) < 0.5 and np.mean(share) < 0.3
    everything = list(forest.candidates(x[:3], len(x)))
    assert all(len(c) == len(x) for c in everything)


def test_prefixes_of_equal_vectors_end_the_ascent():
    """Copies share whole strings, so a query for them ascends no further."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 16))
    x[200:400] = x[7]
    found = next(ann_forest.Forest(x).candidates(x[7:8], 150))
    assert sorted(found) == [7, *range(200, 400)]


def test_mixed_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)) * rng.lognormal(0, 1, size=(3000, 1))
    ids = np.arange(3000)
    got = answers(nearest(table(spark, ids, x)))
    assert recall(got, brute(ids, x.astype(np.float32).astype(np.float64))) >= 0.9


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1),
        (7, [float("inf"), 1.0], 1), (None, [9.0, 9.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 1.0, 1.0], 1), (20, [-1.0, 0.5], 1), (20, [-1.0, 0.5], 1), (40, [0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, VEC_ID int")
    got = answers(nearest(df))
    assert got == {0: [(1, 2.0), (8, 2.0), (20, -1.0), (20, -1.0)], 20: [(0, -1.0), (1, -2.0), (8, -2.0)]}
    assert answers(nearest(df, F.col("vec_id") == 1, k=1)) == {1: [(8, 4.0)]}
    assert nearest(df.where("false")).count() == 0
    extreme = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e-320, 0.0]), (3, [1e200, 1.0])], "vec_id long, embedding array<double>")
    assert [i for i, _ in answers(nearest(extreme))[0]] == [3, 1, 2]
