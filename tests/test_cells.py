"""Nearest cosines in cells against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, vectors


def brute(a, b, tau):
    out = {}
    unit = lambda m: m / max(np.linalg.norm(m), 1e-12)
    for k, x in a:
        s = [unit(x) @ unit(y) for j, y in b if j != k]
        out[k] = (max(s, default=-np.inf), sum(v > tau for v in s))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, [float(t) for t in x]) for k, x in rows], "key long, v array<double>")


def clustered(rng, n, groups, spread, width=8):
    centres = rng.normal(size=(groups, width))
    return [(k, centres[k % groups] + spread * rng.normal(size=width)) for k in range(n)]


@pytest.mark.parametrize("tau", [0.95, 0.3, -0.5])
def test_nearest_equals_all_cosines(spark, monkeypatch, tau):
    monkeypatch.setattr(cells, "PART", 7)
    rng = np.random.default_rng(1)
    rows = clustered(rng, 90, 6, 0.05) + [(100 + k, rng.normal(size=8)) for k in range(20)]
    rows += [(200 + k, np.zeros(8)) for k in range(3)] + [(300 + k, rows[0][1]) for k in range(30)] + [(400, 2 * rows[1][1])]
    d = frame(spark, rows)
    got = {r.key: r for r in cells.nearest(d, d, "key", "v", tau, pivots=9).collect()}
    want = brute(rows, rows, tau)
    assert got.keys() == want.keys()
    for k, (best, over) in want.items():
        assert got[k].best == pytest.approx(best, abs=1e-9) and got[k].over == over, k
    # two sides, with some keys on both
    a, b = rows[:70], rows[40:]
    got = {r.key: r for r in cells.nearest(frame(spark, a), frame(spark, b), "key", "v", tau, pivots=5).collect()}
    for k, (best, over) in brute(a, b, tau).items():
        assert got[k].best == pytest.approx(best, abs=1e-9) and got[k].over == over, k


def test_same_rows_as_blocks_and_far_fewer_pairs(spark):
    rng = np.random.default_rng(2)
    n = 6000
    d = frame(spark, clustered(rng, n, 60, 0.02, 16))
    cell = {r.key: r for r in cells.nearest(d, d, "key", "v", 0.9).collect()}
    block = {r.key: r for r in vectors.nearest(d, d, "key", "v", 0.9).collect()}
    assert all(cell[k].best == pytest.approx(r.best, abs=1e-9) and cell[k].over == r.over for k, r in block.items()) and len(cell) == n
    assert sum(r.compared for r in cell.values()) < 0.05 * n * n


def test_a_third_of_the_rows_are_copies(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=8)
    rows = [(k, one if k % 3 == 0 else rng.normal(size=8)) for k in range(600)]
    got = {r.key: r for r in cells.nearest(frame(spark, rows), frame(spark, rows), "key", "v", 0.99).collect()}
    assert {got[k].over for k in range(0, 600, 3)} == {199} and max(r.compared for r in got.values()) <= 401


def test_no_rows_and_no_others(spark):
    none, single = frame(spark, [(1, np.ones(3))]).where("key < 0"), frame(spark, [(1, np.ones(3))])
    assert cells.nearest(none, single, "key", "v", 0.5).count() == 0
    for d in (single, single.where("key < 0")):
        r = cells.nearest(single, d, "key", "v", 0.5).first()
        assert (r.best, r.over) == (float("-inf"), 0)
    zeros = frame(spark, [(k, np.zeros(3)) for k in range(4)])
    assert {(r.best, r.over) for r in cells.nearest(zeros, zeros, "key", "v", 0.5).collect()} == {(0.0, 0)}
    null = single.union(single.select(F.lit(2).cast("long"), F.lit(None).cast("array<double>")))
    assert [r.key for r in cells.nearest(null, null, "key", "v", 0.5).collect()] == [1]
