"""Log-probabilities that a table stores reach the verbs that train and judge a head, and bad ones are refused."""

import json
import math

import numpy as np
import pytest

from tessera import cli, config
from tessera.errors import DataError

NAMES = cli.STORED
SCHEMA = "prompt string, chosen string, rejected string, " + ", ".join(f"{c} double" for c in NAMES)


def records(n):
    rng = np.random.default_rng(3)
    return [(f"prompt {i}", f"good answer {i} of {i % 7}", f"bad answer {i}", *(float(x) for x in rng.uniform(-40, -5, 4))) for i in range(n)]


def settings(tmp_path, path, **more):
    given = [f"data.train_path={path}", f"data.val_path={path}", f"out_dir={tmp_path}/runs", "profile.width=8"]
    return config.load(None, given + [f"{k}={v}" for k, v in more.items()])


def written(spark, tmp_path, rows, schema=SCHEMA):
    path = f"{tmp_path}/pairs.parquet"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return path


def test_each_pair_has_the_numbers_of_its_own_record(spark, tmp_path):
    rows = records(60)
    found = cli._scored(spark, settings(tmp_path, written(spark, tmp_path, rows)), f"{tmp_path}/pairs.parquet").collect()
    assert {(r.prompt, r.chosen, r.rejected, *(r[c] for c in NAMES)) for r in found} == set(rows)


def test_the_loss_of_a_head_of_zeros_is_that_of_the_numbers(spark, tmp_path):
    rows = records(60)
    cfg = settings(tmp_path, written(spark, tmp_path, rows))
    cli.train(spark, cfg)
    curve = json.loads((tmp_path / "runs/run/train_report.json").read_text())["curve"]
    own = [(pc - rc) - (pr - rr) for _, _, _, pc, pr, rc, rr in rows]
    assert curve[0][2] == pytest.approx(sum(math.log1p(math.exp(-0.1 * x)) for x in own) / len(own))


def test_arena_winners_keep_their_numbers(spark, tmp_path):
    rows = [("p", "left", "right", "b", -1.0, -2.0, -3.0, -4.0), ("q", "left", "right", "a", -5.0, -6.0, -7.0, -8.0)]
    schema = "prompt string, response_a string, response_b string, winner string, " + ", ".join(f"{c} double" for c in NAMES)
    path = written(spark, tmp_path, rows, schema)
    found = cli._scored(spark, settings(tmp_path, path, **{"data.layout": "arena"}), path).collect()
    assert {(r.prompt, r.chosen, r.policy_chosen, r.ref_rejected) for r in found} == {("p", "right", -1.0, -4.0), ("q", "left", -5.0, -8.0)}


@pytest.mark.parametrize("bad", [None, float("nan"), float("-inf")])
def test_numbers_that_are_not_finite_are_refused(spark, tmp_path, bad):
    rows = records(9)
    rows[4] = (*rows[4][:-1], bad)
    path = written(spark, tmp_path, rows)
    with pytest.raises(DataError, match="ref_rejected"):
        cli._scored(spark, settings(tmp_path, path), path)


def test_some_columns_alone_are_refused(spark, tmp_path):
    path = written(spark, tmp_path, [r[:5] for r in records(9)], SCHEMA.rsplit(", ", 2)[0])
    with pytest.raises(DataError, match="ref_chosen"):
        cli._scored(spark, settings(tmp_path, path), path)
    assert cli.main(["train", "--set", f"data.train_path={path}", f"data.val_path={path}", f"out_dir={tmp_path}/runs"], spark) == 2


def test_groups_of_many_responses_are_refused(spark, tmp_path):
    schema = "prompt string, responses array<string>, scores array<double>, " + ", ".join(f"{c} double" for c in NAMES)
    path = written(spark, tmp_path, [("p", ["a", "b"], [1.0, 0.0], -1.0, -1.0, -1.0, -1.0)], schema)
    with pytest.raises(DataError, match="kway"):
        cli._scored(spark, settings(tmp_path, path, **{"data.layout": "kway"}), path)


def test_a_table_without_them_starts_from_zero(spark, tmp_path):
    path = written(spark, tmp_path, [r[:3] for r in records(9)], "prompt string, chosen string, rejected string")
    assert {r[c] for r in cli._scored(spark, settings(tmp_path, path), path).collect() for c in NAMES} == {0.0}
