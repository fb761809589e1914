import random

import pytest

from prosemill.operators import audit


@pytest.mark.parametrize("size", [1, 2, 3, 10, 999, 5000])
def test_latency_summary_as_sorted(spark, size):
    rng = random.Random(size)
    rows = [(g, rng.choice([rng.random(), 0.5, float(rng.randrange(5))])) for g in ("a", "b") for _ in range(size)] + [("a", None)]
    got = {r.g: r for r in audit.latency_summary(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    for g in ("a", "b"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        n = len(v)
        assert (got[g].n, got[g].p95, got[g].max, got[g].min) == (n, v[min(n - 1, int(0.95 * n))], v[-1], v[0])
        assert got[g].median == (v[(n - 1) // 2] + v[n // 2]) / 2 and abs(got[g].mean - sum(v) / n) < 1e-9


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    assert audit.latency_summary(df, "v").first().median == 2.0
    assert audit.latency_summary(df.where("false"), "v").count() == 0


def test_snapshot_differences(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "page long, pos long, value string")
    b = spark.createDataFrame([(1, 0, "x"), (1, 1, "w")], "page long, pos long, value string")
    assert sorted(map(tuple, audit.positional_changes(a, b).collect()), key=str) == [(1, 1, "y", "w"), (2, None, None, None)]
    t = lambda rows: spark.createDataFrame(rows, "page long, pos long, attrs array<string>")
    assert [tuple(r) for r in audit.attribute_changes(t([(1, 0, ["a", "b"])]), t([(1, 0, ["b", "c"])])).collect()] == [(1, 0, ["a"], ["c"])]
    labels = lambda rows: spark.createDataFrame(rows, "page long, pos long, label string")
    text = spark.createDataFrame([(1, "the link text")], "page long, text string")
    lost = audit.lost_anchors(labels([(1, 0, "link"), (1, 1, "gone"), (1, 2, "x"), (1, 3, "ok")]), labels([(1, 0, ""), (1, 1, ""), (1, 3, "ok")]), text)
    assert {r.pos: r.kind for r in lost.collect()} == {0: "misplaced", 1: "deleted", 2: "orphaned"}
