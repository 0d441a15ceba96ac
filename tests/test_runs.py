"""Calls to a judge, fits over stored log-probabilities, settings, run logs, and keys that hold most of the rows."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.errors import ConfigError, DataError, brief
from tessera.operators import dpo_train, formats, order, seams, splits, vectors
from tessera.operators.transport import Caller, Rules
from tessera.sources import sinks


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def sleep(self, seconds):
        self.waits.append(seconds)
        self.now += seconds


def caller(replies, clock, **rules):
    replies, sent = iter(replies), []

    def post(payload):
        sent.append(dict(payload))
        reply = next(replies)
        if isinstance(reply, Exception):
            raise reply
        return reply

    return Caller(post, {"seed": 1, "temperature": 0}, Rules(**rules), clock.sleep, lambda: clock.now, lambda: 0.5), sent


def test_calls_are_repeated_with_growing_waits():
    clock = Clock()
    ask, sent = caller([(429, ""), OSError("reset"), (503, ""), (200, "yes")], clock, longest=5.0)
    assert ask(["t"]) == [("yes", None, 4)] and clock.waits == [2.5, 4.5, 5.5] and len(sent) == 4
    ask, _ = caller([(500, "")] * 3, clock, retries=2)
    assert ask(["t"]) == [(None, "status 500 in call 3", 3)]
    ask, _ = caller([(404, "")], clock)
    assert ask(["t"])[0].error == "status 404 in call 1"


def test_refused_parameters_are_left_out_from_then_on():
    ask, sent = caller([(400, "temperature is fixed"), (400, "unknown: seed"), (200, "a"), (200, "b")], Clock())
    assert [a.raw for a in ask(["t", "u"])] == ["a", "b"] and [sorted(p) for p in sent] == [["seed", "temperature", "text"], ["seed", "text"], ["text"], ["text"]]
    ask, _ = caller([(400, "text is too long")], Clock())
    assert ask(["t"])[0].attempts == 1 and ask.refused == []


def test_calls_are_paced_and_end_after_failures_in_a_row():
    clock = Clock()
    ask, _ = caller([(200, "a"), (200, "b"), (200, "c")], clock, interval=2.0)
    ask(["t", "u", "v"])
    assert clock.waits == [2.0, 2.0]
    ask, sent = caller([(404, ""), (200, "a"), (404, ""), (404, "")], Clock(), failures=2)
    assert [a.error is None for a in ask(list("abcdef"))] == [False, True, False, False, False, False] and len(sent) == 4


def test_dpo_gradient_and_fit(spark):
    rng = np.random.default_rng(1)
    delta, own, w = rng.normal(size=(40, 5)), rng.normal(size=40), rng.normal(size=5)
    g, loss, right, n = dpo_train.sums(delta, own, w, 0.3)
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert (dpo_train.sums(delta, own, w + step, 0.3)[1] - dpo_train.sums(delta, own, w - step, 0.3)[1]) / 2e-6 == pytest.approx(g[k], abs=1e-6)
    assert dpo_train.sums(delta, np.zeros(40), np.zeros(5), 0.3)[1] / 40 == pytest.approx(math.log(2))
    truth = np.array([1.0, -2.0, 0.5, 0, 0])
    data = [(i, (x * np.sign(x @ truth)).tolist(), 0.0, 0.0, 0.0, 0.0) for i, x in enumerate(rng.normal(size=(300, 5)))]
    rows = spark.createDataFrame(data, "id long, delta array<double>, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    found = dpo_train.fit(rows.where("id < 200"), rows.where("id >= 200"), beta=1.0, steps=40, every=5, patience=2)
    table = dpo_train.report(spark, found).collect()
    assert table[0].step == 0 and table[0].val_accuracy == 0.5 and not table[0].selected and sum(r.selected for r in table) == 1
    assert max(r.val_accuracy for r in table) > 0.9 and table[-1].train_loss < table[0].train_loss
    with pytest.raises(DataError):
        dpo_train.fit(rows.limit(0), rows)


def test_settings():
    with pytest.raises(ConfigError, match="loss.beta"):
        config.validate_dpo(config.override(config.DPOConfig(), ["policy.model_name=m", "loss.beta=-1"]))
    assert config.validate_dpo(config.override(config.DPOConfig(), ["policy.model_name=m"])).loss.beta == 0.1
    for bad in ({"split": {"seed": 2.5}}, {"run_name": 7}, {"split": {"val_frac": True}}, {"split": {"seed": float("inf")}}):
        with pytest.raises(ConfigError):
            config.from_dict(config.Config, bad)
    assert config.from_dict(config.Config, {"split": {"seed": 3.0}, "data": {"slice_keys": "a,,b "}}).data.slice_keys == ("a", "b")
    assert brief("x" * 200, 20) == "'xxxxxxxx...xxxxxxx'" or len(brief("x" * 200, 20)) == 20


def test_run_log_tells_sinks_and_console(tmp_path):
    seen, console = [], io.StringIO()
    log = sinks.RunLog(str(tmp_path / "run"), sinks=[seen.append], console=console)
    log.log(1, echo=True, loss=0.5)
    log.log(2, loss=float("nan"))
    with pytest.raises(ValueError), log.timer("block"):
        raise ValueError
    log.say("done")
    assert [r.get("loss") for r in seen] == [0.5, "nan", None] and "seconds/block" in seen[2] and log.not_finite == 1
    assert console.getvalue().splitlines() == ["step=1 loss=0.5", "done"] and (tmp_path / "run" / "console.log").read_text().splitlines() == ["step=1 loss=0.5", "done"]


def test_frequent_values_are_dealt_over_ranges(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).alias("v"))
    got = order.with_index(rows, ["v"], "i")
    assert sorted(r.i for r in got.select("i").collect()) == list(range(2000))
    sizes = [n for n in got.rdd.glom().map(len).collect() if n]
    assert max(sizes) < 0.5 * 2000 and len(sizes) > 1
    pairs = spark.createDataFrame([(f"c{i % 3}", "r") for i in range(900)], "chosen string, rejected string")
    first, second = (formats.load_groups(pairs.repartition(k), "pairwise_implicit").select("uid", F.element_at("responses", 1).alias("c")).collect() for k in (2, 7))
    assert sorted(first) == sorted(second) and sorted(r.uid for r in first) == list(range(900))


def test_copies_of_a_frequent_record(spark):
    data = [(i, "same" if i % 10 else f"t{i}") for i in range(400)]
    rows = spark.createDataFrame(data, "row long, text string")
    got = {r.row: r.copy for r in splits.row_dedup(rows, "row").collect()}
    seen: dict = {}
    for i, t in data:
        assert got[i] == seen.get(t, 0)
        seen[t] = seen.get(t, 0) + 1
    assert {r.row for r in splits.unique_rows(rows, "text", "row").collect()} == {1, *range(0, 400, 10)}


def test_random_split_by_numbers_or_by_hash(spark, monkeypatch):
    rows = spark.createDataFrame([(f"p{i % 50}",) for i in range(200)], "prompt string")
    prompts = sorted({f"p{i}" for i in range(50)})
    want = {prompts[i] for i in np.random.default_rng(3).permutation(50)[:10]}
    assert {r.prompt for r in splits.assign_random(rows, 0.2, 3).where("is_val").collect()} == want
    monkeypatch.setattr(splits, "PERMUTED", 10)
    by_hash = splits.assign_random(rows, 0.2, 3)
    assert by_hash.count() == 200 and by_hash.where("is_val").select("prompt").distinct().count() == 10


def test_views_of_other_keys_are_refused(spark):
    a, b = (spark.createDataFrame([(k, [float(k)]) for k in ks], "key long, vector array<double>") for ks in ((1, 2), (2, 1)))
    assert {(r.key, r.a[0], r.b[0]) for r in vectors.zip_views({"a": a, "b": b}, "key").collect()} == {(1, 1.0, 1.0), (2, 2.0, 2.0)}
    with pytest.raises(Exception, match="no b for 2"):
        vectors.zip_views({"a": a, "b": b.where("key = 1")}, "key").collect()


def test_generations_are_taken_up(spark, tmp_path):
    path, calls = f"file://{tmp_path}/out", spark.sparkContext.accumulator(0)

    def write(prompts, k):
        calls.add(len(prompts))
        return [p.upper() for p in prompts]

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id long, prompt string")
    seams.generate_resumable(prompts.where("id < 5"), path, "id", write)
    got = seams.generate_resumable(prompts, path, "id", write)
    assert {(r.id, r.response) for r in got.collect()} == {(i, f"P{i}") for i in range(20)} and calls.value == 20
    with pytest.raises(ConfigError):
        seams.generate_resumable(prompts.withColumn("response", F.lit("")), path, "id", write)
