"""Joins of all blocks with all: equal to one matrix, and no vector is shuffled once for each block that it meets."""

import numpy as np
import pytest

from tessera.operators import cells, mmd, vectors


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(mmd, "BLOCK", 16)
    monkeypatch.setattr(cells, "PART", 16)


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "key long, v array<double>")


def test_blocks_against_one_matrix(spark, small):
    x, y = np.random.default_rng(1).normal(size=(90, 5)), np.random.default_rng(2).normal(size=(50, 5))
    a, b = table(spark, x), table(spark, y, 80)  # keys 80 to 89 on both sides
    for left, right, u, w, shift in ((a, a, x, x, 0), (a, b, x, y, 80)):
        other = np.arange(len(u))[:, None] != shift + np.arange(len(w))[None, :]
        s = np.where(other, u @ w.T / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(w, axis=1), -np.inf)
        near = vectors.nearest(left, right, "key", "v", 0.5)
        for r in near.collect():
            assert abs(r.best - s[r.key].max()) < 1e-12 and r.over == (s[r.key] > 0.5).sum()
        k = np.exp(-0.3 * ((u[:, None] - w[None]) ** 2).sum(axis=2)) * other
        for r in vectors.kernel_sums(left, right, "key", "v", 0.3).collect():
            assert abs(r.total - k[r.key].sum()) < 1e-9
        assert near.count() == len(u)


def shuffled(spark, make):
    """Records that all stages write for shuffles while make() runs."""
    store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True)
    total = lambda: sum(store().apply(i).totalShuffleWrite() for i in range(store().length()))
    before = total()
    make()
    return total() - before


@pytest.mark.parametrize("join", ["nearest", "cells", "mmd"])
def test_bytes_grow_as_the_rows(spark, small, join):
    def run(n):
        rows = table(spark, np.random.default_rng(3).normal(size=(n, 32)))
        if join == "nearest":
            vectors.nearest(rows, rows, "key", "v", 0.9).count()
        elif join == "cells":
            cells.nearest(rows, rows, "key", "v", 0.0).count()
        else:
            mmd.permutation_test(rows.where("key % 2 = 0"), rows.where("key % 2 = 1"), "v", "key", permutations=5, gamma=0.5).count()

    few, many = shuffled(spark, lambda: run(300)), shuffled(spark, lambda: run(1200))
    assert 0 < many < 6 * few


def test_hashed_tokens_are_counted_in_one_walk(spark):
    rows = spark.createDataFrame([(1, "a b a\nc"), (2, ""), (3, None)], "i long, text string")
    made = vectors.hash_embed(rows, "text", 4)
    got = {r.i: r.vector for r in made.collect()}
    bucket = {r.t: r.b for r in spark.sql("select t, cast(pmod(xxhash64(t), 4) as int) b from values ('a'), ('b'), ('c'), ('\\n') as v(t)").collect()}
    assert got[1] == [sum(bucket[t] == i for t in ("a", "b", "a", "\n", "c")) for i in range(4)] and got[2] == [0.0] * 4 and len(got[3]) == 4
    assert "filter(" not in made._jdf.queryExecution().optimizedPlan().toString()
