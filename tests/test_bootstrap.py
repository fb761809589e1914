import random

import numpy as np
import pytest

from prosemill.operators import metrics
from prosemill.plans import metrics as plans


def draws(n, resamples=1000, seed=42):
    rng = random.Random(seed)
    return [[rng.randrange(n) for _ in range(n)] for _ in range(resamples)]


def test_all_rows_as_brute_force(spark, small):
    rows = plans._evaluation_set(spark, small).cache()
    n = rows.count()
    assert rows.select("idx").distinct().count() == n == plans.scored(spark, small).count()
    copy = rows.selectExpr("idx", "source", "source AS candidate", "references")
    a, b = ({r.idx: r.d_sari for r in metrics.document_sari(x).collect()} for x in (rows, copy))
    d = np.array([a[i] - b[i] for i in sorted(a)])
    got = plans.paired_bootstrap(spark, small).first()
    assert (got.n, got.resamples) == (n, 1000) and got.delta == pytest.approx(d.mean())
    assert got.p == pytest.approx(1 - sum(d[x].sum() > 0 for x in draws(n)) / 1000)


def test_sari_as_brute_force(spark, small):
    rows = plans._evaluation_set(spark, small)
    copy = rows.selectExpr("idx", "source", "source AS candidate", "references")
    ids = sorted(r.idx for r in rows.select("idx").collect())
    at = {i: k for k, i in enumerate(ids)}
    k = np.zeros((2, len(ids), 4, 9))
    for i, x in enumerate((rows, copy)):
        for r in metrics.sari_statistics(x, ["idx"]).collect():
            k[i, at[r.idx], r.n - 1] = [r[c] for c in metrics.SARI_SUMS]
    ratio = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=y > 0)
    f1 = lambda p, r: ratio(2 * p * r, p + r)

    def sari(s):
        kg, ks, kr, dg, ds, _, ag, a_s, ar = (s[:, j] for j in range(9))
        return 100 * ((f1(ratio(kg, ks), ratio(kg, kr)) + ratio(dg, ds) + f1(ratio(ag, a_s), ratio(ag, ar))) / 3).sum() / 4

    d = [sari(k[0, x].sum(axis=0)) - sari(k[1, x].sum(axis=0)) for x in draws(len(ids))]
    got = plans.paired_bootstrap_sari(spark, small).first()
    assert list(got) == pytest.approx([np.mean(d), *np.percentile(d, [2.5, 97.5]), np.mean([x <= 0 for x in d])])


def test_blocks_draw_all_rows():
    sizes = [2000, 1, 2048, 900, 1500]
    times = np.concatenate([metrics.block_times(b, sizes, 300, 1) for b in range(5)], axis=1)
    assert times.shape == (300, sum(sizes)) and (times.sum(axis=1) == sum(sizes)).all()
    assert abs(times.var() - 1) < 0.02 and abs(times[:, :2000].sum(axis=1).std() - (2000 * (1 - 2000 / sum(sizes))) ** 0.5) < 5
