"""The blockwise permutation test against one kernel matrix with the same marks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import mmd, vectors


def frame(spark, m, start=0):
    return spark.createDataFrame([(start + k, [float(t) for t in x]) for k, x in enumerate(m)], "key long, v array<double>")


def plain(x, y, gamma):
    def kernel(a, b):
        return np.exp(-gamma * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))

    xx, yy, m, k = kernel(x, x), kernel(y, y), len(x), len(y)
    return (xx.sum() - m) / (m * (m - 1)) + (yy.sum() - k) / (k * (k - 1)) - 2 * kernel(x, y).mean()


def test_marks_are_uniform_choices_of_m_rows():
    n, m, size, r = 23, 9, 5, 4000
    whole = np.vstack([mmd.marks(b, n, m, r, 3, size) for b in range(5)])
    assert whole.shape == (n, r) and (whole.sum(axis=0) == m).all()
    assert abs(whole.mean(axis=1) - m / n).max() < 0.04
    together = (whole[0] * whole[22]).mean()  # rows of different blocks
    assert together == pytest.approx(m * (m - 1) / (n * (n - 1)), abs=0.03)
    assert (mmd.marks(2, n, m, r, 3, size) == whole[10:15]).all() and not (mmd.marks(2, n, m, r, 4, size) == whole[10:15]).all()


def test_equals_one_matrix_with_the_same_marks(spark, monkeypatch):
    monkeypatch.setattr(mmd, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(61, 3)), rng.normal(size=(54, 3)) + 0.3
    a, b = frame(spark, x), frame(spark, y, 1000)
    r = mmd.permutation_test(a, b, "v", "key", permutations=60, gamma=0.4, seed=5).first()
    assert r.mmd2 == pytest.approx(plain(x, y, 0.4), abs=1e-12) and (r.n_a, r.n_b, r.gamma, r.status) == (61, 54, 0.4, "ok")
    # the order that numbers rows, then every permutation's statistic by itself
    keyed = a.select("key", "v").union(b.select("key", "v")).orderBy(F.xxhash64("key")).collect()
    z = np.array([q.v for q in keyed])
    chosen = np.vstack([mmd.marks(i, 115, 61, 60, 5, 16) for i in range(8)]).astype(bool)
    each = [plain(z[c], z[~c], 0.4) for c in chosen.T]
    assert r.p_value == pytest.approx((1 + sum(e >= r.mmd2 for e in each)) / 61)


def test_agrees_with_the_test_on_a_sample_and_tells_sides_apart(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(1300, 4)), rng.normal(size=(700, 4))
    a, b = frame(spark, x), frame(spark, y, 5000)
    small = vectors.mmd_test(a, b, "v", "key", max_rows=2000).first()
    whole = mmd.permutation_test(a, b, "v", "key", gamma=small.gamma).first()
    assert whole.mmd2 == pytest.approx(small.mmd2, abs=1e-9) and abs(whole.p_value - small.p_value) < 0.15
    assert mmd.permutation_test(a, b, "v", "key").first().gamma == pytest.approx(small.gamma, rel=0.05)
    moved = mmd.permutation_test(a, frame(spark, y + 0.5, 5000), "v", "key").first()
    assert moved.p_value < 0.01


def test_few_rows_and_nulls(spark):
    a = frame(spark, np.ones((60, 2)))
    few = mmd.permutation_test(a, a.limit(3), "v", "key").first()
    assert (few.status, few.mmd2, few.n_a, few.n_b) == ("unavailable", None, 60, 3)
    null = spark.createDataFrame([(9, None)], "key long, v array<double>")
    r = mmd.permutation_test(a.union(null), a, "v", "key", permutations=5).first()
    assert (r.n_a, r.p_value, r.status) == (60, 1.0, "ok") and r.mmd2 == pytest.approx(0, abs=1e-12)
