"""The query without SQL of plans/store_queries.py against a plain loop over its own features."""

import numpy as np
import pytest

from tessera.operators import dpo_train
from tessera.operators.tokens import epoch_batches
from tessera.plans import store_queries


def test_train_dpo_batches_equals_a_plain_loop(spark, sf_dir):
    rows = store_queries.dpo_features(spark, sf_dir).collect()
    assert len(rows) > 10 and all(r.ref_chosen < 0 and r.policy_chosen != r.ref_chosen for r in rows)
    own = {r.pair_uid: r.policy_chosen - r.ref_chosen - r.policy_rejected + r.ref_rejected for r in rows}
    delta = {r.pair_uid: np.array(r.delta) for r in rows}
    train, val = ([k for k in own if (k % 5 == 0) == side] for side in (False, True))
    keys = spark.createDataFrame([(k,) for k in train], "pair_uid long")
    each = -(-len(train) // 256)
    w, square, step, curve = np.zeros(16), np.zeros(16), 0, {}
    total = 2 * each
    for epoch in range(2):
        batches = {}
        for r in epoch_batches(keys, "pair_uid", 0, epoch, 256).collect():
            batches.setdefault(r.batch, []).append(r.pair_uid)
        for _, ids in sorted(batches.items()):
            g, _, _, n = dpo_train.sums(np.array([delta[i] for i in ids]), np.array([own[i] for i in ids]), w, 0.1)
            g = g / n + 1e-3 * w
            square += g * g
            progress = min(max(step - 2, 0) / max(total - 2, 1), 1.0)
            factor = (step + 1) / 2 if step < 2 else 1 - progress
            w = w - 0.5 * factor * g / (np.sqrt(square) + 1e-12)
            step += 1
            m = 0.1 * (np.array([own[i] for i in val]) + np.array([delta[i] for i in val]) @ w)
            curve[step] = float((m > 0).mean() + 0.5 * (m == 0).mean())
    got = {r.step: r.val_accuracy for r in store_queries.train_dpo_batches(spark, sf_dir).collect()}
    assert max(got) == total and {k: v for k, v in got.items() if k} == pytest.approx({k: v for k, v in curve.items() if k in got})
