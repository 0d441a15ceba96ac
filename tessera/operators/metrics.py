"""Metrics of scored pairs, rewards, judgements and receipts."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.numbers import half_credit, sigmoid, softplus
from .order import linear_rule, quantiles

_MARGINS = {"p10_margin": linear_rule(0.1), "median_margin": linear_rule(0.5), "p90_margin": linear_rule(0.9)}


def _pair_aggregates() -> list[Column]:
    c, r = F.col("r_chosen"), F.col("r_rejected")
    acc = F.avg(half_credit(c, r))
    return [
        F.count("*").alias("n_pairs"), acc.alias("accuracy"), F.sqrt(acc * (1 - acc) / F.count("*")).alias("accuracy_se"), F.avg((c == r).cast("double")).alias("frac_ties"), F.avg(c - r).alias("mean_margin"), F.avg(c).alias("mean_chosen"),
        F.avg(r).alias("mean_rejected"), F.max(F.greatest(F.abs(c), F.abs(r))).alias("abs_reward_max"), F.avg(softplus(-(c - r))).alias("mean_loss"),
    ]


def pair_metrics(scored: DataFrame) -> DataFrame:
    """One row over r_chosen and r_rejected: accuracy (ties for half), margins, losses; no row without pairs."""
    rows = scored.agg(*_pair_aggregates()).where("n_pairs > 0")
    return rows.crossJoin(quantiles(scored.select((F.col("r_chosen") - F.col("r_rejected")).alias("m")), "m", _MARGINS))


def by_slice(scored: DataFrame) -> DataFrame:
    """A row for each pair and slice `key=value`; empty values give none."""
    rows = scored.select("*", F.explode("slices").alias("_k", "_v")).where(F.coalesce(F.col("_v"), F.lit("")) != "")
    return rows.withColumn("slice", F.concat("_k", F.lit("="), "_v")).drop("_k", "_v")


def slice_metrics(scored: DataFrame) -> DataFrame:
    """pair_metrics for every slice."""
    rows = by_slice(scored)
    return rows.groupBy("slice").agg(*_pair_aggregates()).join(quantiles(rows.select("slice", (F.col("r_chosen") - F.col("r_rejected")).alias("m")), "m", _MARGINS, ["slice"]), "slice")


def eval_result(scored: DataFrame) -> DataFrame:
    """slice (`all` first of them all) with the metrics of each."""
    return pair_metrics(scored).withColumn("slice", F.lit("all")).unionByName(slice_metrics(scored))


def flatten_eval(result: DataFrame, prefix: str = "eval/") -> DataFrame:
    """key, value: every metric of eval_result under `eval/metric` or `eval/slice/metric`."""
    names = [c for c in result.columns if c != "slice"]
    each = F.array(*(F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("value")) for c in names))
    rows = result.select("slice", F.explode(each).alias("x"))
    return rows.select(F.concat(F.lit(prefix), F.when(F.col("slice") == "all", "").otherwise(F.concat("slice", F.lit("/"))), F.col("x.m")).alias("key"), F.col("x.value").alias("value"))


def bt_loss(scored: DataFrame, margin: float = 0.0) -> DataFrame:
    """scored with loss: softplus of the margin that is missing."""
    if margin < 0:
        raise ConfigError("margin must not be negative")
    return scored.withColumn("loss", softplus(-(F.col("r_chosen") - F.col("r_rejected") - F.lit(float(margin)))))


def _dpo_aggregates(beta: float) -> list[Column]:
    if not beta > 0:
        raise ConfigError("beta must be above 0")
    pc, pr, rc, rr = (F.col(c).cast("double") for c in ("policy_chosen", "policy_rejected", "ref_chosen", "ref_rejected"))
    win, lose = beta * (pc - rc), beta * (pr - rr)
    delta = win - lose
    share = lambda c: F.avg(c.cast("double"))
    return [
        F.count("*").alias("n_pairs"), F.avg(softplus(-delta)).alias("loss"), share(delta > 0).alias("accuracy"), F.avg(delta).alias("delta_mean"), F.avg(win).alias("reward_chosen"), F.avg(lose).alias("reward_rejected"), F.avg(win - lose).alias("reward_margin"),
        F.avg(pc).alias("policy_logp_chosen"), F.avg(pr).alias("policy_logp_rejected"), F.avg(rc).alias("ref_logp_chosen"), F.avg(rr).alias("ref_logp_rejected"), F.avg(pc - rc).alias("logratio_chosen"), F.avg(pr - rr).alias("logratio_rejected"),
        share(pc < rc).alias("frac_winner_below_ref"), share(pr < rr).alias("frac_loser_below_ref"), share(sigmoid(-delta) < 0.01).alias("frac_pairs_saturated"), F.avg(sigmoid(-delta)).alias("grad_weight_mean"),
    ]


def dpo_metrics(scored: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row over policy_* and ref_* log-probabilities; ties earn nothing here."""
    return scored.agg(*_dpo_aggregates(beta))


def dpo_slice_metrics(scored: DataFrame, beta: float = 0.1) -> DataFrame:
    return by_slice(scored).groupBy("slice").agg(*_dpo_aggregates(beta))


def dpo_loss(scored: DataFrame, beta: float = 0.1, sft_weight: float = 0.0, lengths: str | None = None) -> DataFrame:
    """One row: loss, the mean preference loss less sft_weight times the mean log-probability a token of the chosen side."""
    if not beta > 0 or sft_weight < 0:
        raise ConfigError("beta must be above 0 and sft_weight not negative")
    delta = beta * ((F.col("policy_chosen") - F.col("ref_chosen")) - (F.col("policy_rejected") - F.col("ref_rejected")))
    sft = F.avg(F.col("policy_chosen") / (F.greatest(F.col(lengths), F.lit(1)) if lengths else F.lit(1)))
    return scored.agg(F.avg(softplus(-delta)).alias("preference_term"), sft.alias("sft_term")).withColumn("loss", F.col("preference_term") - sft_weight * F.col("sft_term"))


def step_zero(scored: DataFrame) -> DataFrame:
    """The largest deviation of policy from reference on each side; must be about 0 before training."""
    dev = lambda s: F.max(F.abs(F.col(f"policy_{s}") - F.col(f"ref_{s}")))
    return scored.agg(dev("chosen").alias("max_dev_chosen"), dev("rejected").alias("max_dev_rejected"))


def saturation_slices(scored: DataFrame, masks: list[str], min_pairs: int = 50) -> DataFrame:
    """name, n_pairs, accuracy, accuracy_se of every boolean column of masks with min_pairs pairs or more."""
    each = F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).alias("inside")) for m in masks))
    rows = scored.select("r_chosen", "r_rejected", F.explode(each).alias("x")).where("x.inside").select("x.name", "r_chosen", "r_rejected")
    acc = F.avg(half_credit(F.col("r_chosen"), F.col("r_rejected")))
    return rows.groupBy("name").agg(F.count("*").alias("n_pairs"), acc.alias("accuracy"), F.sqrt(acc * (1 - acc) / F.count("*")).alias("accuracy_se")).where(F.col("n_pairs") >= min_pairs)


# --- rewards -------------------------------------------------------------------------------------------------------------


def reward_weights(names: list[str], weights: list[float] | None = None, normalise: bool = False) -> dict[str, float]:
    """The weight of each reward, 1 by default; negative ones are fine, names must differ, and a sum of 0 cannot be normalised."""
    if len(set(names)) != len(names):
        raise ConfigError("reward names must differ")
    weights = [1.0] * len(names) if not weights else [float(w) for w in weights]
    if len(weights) != len(names) or not all(math.isfinite(w) for w in weights):
        raise ConfigError("there must be one finite weight for each reward")
    if normalise and names:
        if not sum(weights):
            raise ConfigError("weights that add up to 0 cannot be normalised")
        weights = [w / sum(weights) for w in weights]
    return dict(zip(names, weights))


def optimizer_groups(parameters: DataFrame, rate: float) -> DataFrame:
    """One row over parameters (shape: array of ints, trainable, values: array): tensors and numbers that decay, that do not
    (fewer than two dimensions) and that are frozen, and the share of trainable numbers that a step of `rate` leaves where
    they are in bfloat16: half a unit in the last place is 1/512 of a number, so those over 512 times the rate."""
    if not rate > 0:
        raise ConfigError("the rate must be positive")
    n, flat = F.size("values"), F.size("shape") < 2
    stuck = F.size(F.filter("values", lambda v: F.abs(v) > 512 * rate))
    on = F.col("trainable")
    total = lambda c, where: F.coalesce(F.sum(F.when(where, c)), F.lit(0)).cast("bigint")
    rows = parameters.agg(
        F.count_if(on & ~flat).alias("n_decay_tensors"), total(n, on & ~flat).alias("n_decay"), F.count_if(on & flat).alias("n_flat_tensors"), total(n, on & flat).alias("n_flat"), total(n, ~on).alias("n_frozen"), total(stuck, on).alias("n_stuck")
    )
    return rows.withColumn("frac_stuck", F.coalesce(F.try_divide("n_stuck", F.col("n_decay") + F.col("n_flat")), F.lit(0.0))).drop("n_stuck")


def combine_rewards(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with total, the weighted sum of the named columns; null where there are none."""
    total = sum((F.col(k) * F.lit(w) for k, w in weights.items()), F.lit(0.0)) if weights else F.lit(None).cast("double")
    return rows.withColumn("total", total)


def reward_report(rows: DataFrame, names: list[str]) -> DataFrame:
    """name, mean, least and greatest value of each reward and of the total."""
    names = [*names, "total"]
    row = rows.agg(*(f(F.col(k)).alias(f"{a}_{k}") for k in names for a, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), *(F.col(f"{a}_{k}").alias(a) for a in ("mean", "min", "max"))) for k in names))).alias("x")).select("x.*")


def generation_metrics(rows: DataFrame, response: Callable[[], Column] | None = None) -> DataFrame:
    """One row: n, mean number of new tokens, share of blank responses, of response, n_new_tokens."""
    from ..functions.text import strip

    return rows.agg(F.count("*").alias("n_samples"), F.countDistinct("prompt").alias("n_prompts"), F.avg("n_new_tokens").alias("mean_new_tokens"), F.avg((strip(F.col("response")) == "").cast("double")).alias("frac_empty"))


# --- logs ----------------------------------------------------------------------------------------------------------------


def train_accumulators(log: DataFrame, metrics: list[str], every: int) -> DataFrame:
    """Means of metrics between log points, weighted by the size of each step's batch: columns step, batch, and metrics."""
    window = F.floor((F.col("step") - 1) / every)
    return log.groupBy(((window + 1) * every).alias("step")).agg(*(F.try_divide(F.sum(F.col(m) * F.col("batch")), F.sum("batch")).alias(m) for m in metrics))


def checkpoint_select(evals: DataFrame, min_delta: float = 0.0, patience: int | None = None) -> DataFrame:
    """One row over (run, step, accuracy): best_step, best_metric, and the step at which patience ends the run (null: never).

    An eval improves if it beats the best so far by more than min_delta. A run's evals are few and are folded in order.
    """
    ordered = F.array_sort(F.collect_list(F.struct("step", "accuracy")))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("bigint").alias("at"), F.lit(0).alias("stale"), F.lit(None).cast("bigint").alias("stop"))

    def fold(s: Column, e: Column) -> Column:
        better = s["best"].isNull() | (e["accuracy"] > s["best"] + min_delta)
        over = s["stop"].isNotNull()
        stale = F.when(over, s["stale"]).when(better, 0).otherwise(s["stale"] + 1)
        stop = F.when(over, s["stop"]).when((~better) & (s["stale"] + 1 >= (patience if patience else 1 << 30)), e["step"].cast("bigint"))
        return F.struct(F.when(better & ~over, e["accuracy"]).otherwise(s["best"]).alias("best"), F.when(better & ~over, e["step"].cast("bigint")).otherwise(s["at"]).alias("at"), stale.cast("int").alias("stale"), stop.alias("stop"))

    folded = evals.groupBy("run").agg(F.aggregate(ordered, start, fold).alias("x"))
    return folded.select("run", F.col("x.best").alias("best_metric"), F.col("x.at").alias("best_step"), F.col("x.stop").alias("stopped_at"))


def run_curves(log: DataFrame) -> DataFrame:
    """One row for each run over (run, line, step, loss, accuracy, abs_reward_max): first and last values by line.

    A step is no key of a log, so lines order it; a run's evals are few.
    """
    series = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line", "step", F.col(c).alias("v"))))), lambda x: F.struct(x["step"].alias("step"), x["v"].alias("value")))
    first = lambda c, by: by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    return log.groupBy("run").agg(F.count("step").alias("n_steps_logged"), first("loss", F.min_by).alias("loss_first"), first("loss", F.max_by).alias("loss_last"), series("accuracy").alias("eval_acc_series"), series("abs_reward_max").alias("abs_reward_max_series"))


def margin_extremes(scored: DataFrame, k: int = 8) -> DataFrame:
    """side, uid, margin: the k least and the k greatest margins; equal ones by uid."""
    rows = scored.select("uid", (F.col("r_chosen") - F.col("r_rejected")).alias("margin"))
    worst = rows.orderBy("margin", "uid").limit(k).select(F.lit("worst").alias("side"), "uid", "margin")
    return worst.union(rows.orderBy(F.col("margin").desc(), "uid").limit(k).select(F.lit("best").alias("side"), "uid", "margin"))


def longest_failures(calls: DataFrame) -> DataFrame:
    """run, longest: the most failures in a row over (run, at, failed); a run's calls are read by its own window."""
    w = Window.partitionBy("run").orderBy("at")
    islands = calls.withColumn("_g", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(w)).where("failed")
    return calls.select("run").distinct().join(islands.groupBy("run", "_g").agg(F.count("*").alias("n")).groupBy("run").agg(F.max("n").alias("longest")), "run", "left").select("run", F.coalesce("longest", F.lit(0)).cast("bigint").alias("longest"))
