"""Fits by minibatches: stopped and resumed ones, steps against a plain loop, and ends."""

import numpy as np
import pytest

from tessera.errors import ConfigError, DataError
from tessera.operators import dpo_train as D
from tessera.operators.tokens import epoch_batches
from tessera.sources.snapshots import Snapshots

COLUMNS = "id long, delta array<double>, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double"


def frame(spark, n, start=0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        d = rng.normal(size=4) + [0.4, 0, -0.2, 0]
        rows.append((start + k, d.tolist(), *rng.normal(size=4).tolist()))
    return spark.createDataFrame(rows, COLUMNS)


def test_resumed_fit_has_the_very_weights(spark, tmp_path):
    train, val = frame(spark, 90), frame(spark, 30, 1000, 2)
    plan = D.Plan(epochs=2, batch_size=8, accumulate=2, schedule="cosine", warmup=2, every=3, patience=9)
    whole = D.fit_batches(train, val, "id", plan)
    assert whole.steps == 12 and [c[0] for c in whole.curve] == [0, 3, 6, 9, 12]
    shots = Snapshots(spark, f"file://{tmp_path}/shots", keep_last=2)
    part = D.fit_batches(train, val, "id", plan, shots, stop_after=7)  # after the snapshot of step 6, in the second epoch
    assert part.steps == 7 and shots.steps()[-1] == 6
    resumed = D.fit_batches(train.repartition(5), val, "id", plan, shots)
    assert resumed.weights.tolist() == whole.weights.tolist() and resumed.best_step == whole.best_step
    assert [c[0] for c in resumed.curve] == [c[0] for c in whole.curve]
    assert np.allclose([c[1:] for c in resumed.curve], [c[1:] for c in whole.curve], atol=1e-12)
    done = D.fit_batches(train, val, "id", plan, shots)  # nothing is left to do
    assert done.weights.tolist() == whole.weights.tolist() and done.steps == 12


def test_steps_equal_a_plain_loop(spark):
    train, val = frame(spark, 20), frame(spark, 10, 1000, 2)
    plan = D.Plan(epochs=2, batch_size=6, rate=0.3, every=2, patience=9, seed=4)
    got = D.fit_batches(train, val, "id", plan)
    pairs = {r.id: (np.array(r.delta), r.policy_chosen - r.ref_chosen - r.policy_rejected + r.ref_rejected) for r in train.collect()}
    w, square, states = np.zeros(4), np.zeros(4), {}
    step = 0
    for epoch in range(2):
        batches = {}
        for r in epoch_batches(train, "id", 4, epoch, 6).collect():
            batches.setdefault(r.batch, []).append(r.id)
        assert sorted(len(b) for b in batches.values()) == [2, 6, 6, 6]
        for _, ids in sorted(batches.items()):
            d, own = np.array([pairs[i][0] for i in ids]), np.array([pairs[i][1] for i in ids])
            slope = -0.1 / (1 + np.exp(0.1 * (own + d @ w)))
            g = d.T @ slope / len(ids) + 1e-3 * w
            square += g * g
            w = w - 0.3 * g / (np.sqrt(square) + 1e-12)
            step += 1
            states[step] = w
    assert got.steps == step == 8
    assert got.weights == pytest.approx(states[got.best_step], abs=1e-12)


def test_accumulated_batches_are_one(spark):
    train, val = frame(spark, 32), frame(spark, 10, 1000, 2)
    one = D.fit_batches(train, val, "id", D.Plan(batch_size=8, every=1))
    two = D.fit_batches(train, val, "id", D.Plan(batch_size=4, accumulate=2, every=1))
    assert one.weights == pytest.approx(two.weights, abs=1e-12) and one.steps == two.steps == 4


def test_early_stop_and_faults(spark):
    train = frame(spark, 24)
    val = train.limit(0)
    stopped = D.fit_batches(train, val, "id", D.Plan(epochs=9, batch_size=8, every=1, patience=2))
    assert stopped.stopped_early and stopped.steps == 3 and stopped.best_step == 1
    with pytest.raises(ConfigError):
        D.fit_batches(train, val, "id", D.Plan(batch_size=0))
    with pytest.raises(DataError):
        D.fit_batches(train.limit(0), val, "id")
