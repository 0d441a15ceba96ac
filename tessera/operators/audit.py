"""Tier 0: structure, lengths, trivial baselines, surface probes, a bag-of-words probe, and the warnings they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from ..functions.numbers import chi2, half_credit, hash_unit
from ..functions.text import BASELINES, PROBES, Feature, strip, tokens
from .order import SMALL, floor_rule, quantiles
from .pairs import effective_ranking, has_signal

#: The warnings' bounds.
LEXICAL_BOUND, BASELINE_BOUND, LONGER_LOW, LONGER_HIGH, GAP_BOUND, CEILING = 0.90, 0.80, 0.40, 0.60, 0.30, 0.75


def structure_stats(groups: DataFrame) -> DataFrame:
    """One row: groups, prompts, surplus exact duplicates, groups with equal responses, fully tied, with blank responses."""
    r = effective_ranking(F.col("ranking"), F.col("scores"))
    # distinct rows by a hash of prompt and responses: counts of keys, not of texts, are shuffled
    rows = groups.select(
        F.sha2(F.to_json(F.struct("prompt", "responses")), 256).alias("key"), F.xxhash64("prompt").alias("prompt"), (F.size(F.array_distinct("responses")) < F.size("responses")).alias("same"), (~has_signal(r)).alias("tied"),
        F.exists("responses", lambda x: strip(x) == "").alias("blank"),
    )
    by_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.first("prompt").alias("prompt"), F.count_if("same").alias("same"), F.count_if("tied").alias("tied"), F.count_if("blank").alias("blank"))
    by_prompt = by_key.groupBy("prompt").agg(*(F.sum(c).alias(c) for c in ("n", "same", "tied", "blank")), F.sum(F.col("n") - 1).alias("extra"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return by_prompt.agg(total("n").alias("n_groups"), F.count("*").alias("n_unique_prompts"), total("extra").alias("n_exact_duplicates"), total("same").alias("n_identical_sides"), total("tied").alias("n_all_tied"), total("blank").alias("n_empty_response"))


def k_histogram(groups: DataFrame) -> DataFrame:
    return groups.groupBy(F.size("responses").alias("k")).agg(F.count("*").alias("n_groups"))


def slice_cardinality(groups: DataFrame) -> DataFrame:
    """key, number of different values."""
    each = groups.select(F.explode("slices").alias("key", "value")).distinct()
    return each.groupBy("key").agg(F.count("*").alias("n_values"))


def prompt_leakage(train: DataFrame, val: DataFrame) -> DataFrame:
    """Prompts of val, how many of them train has, and their share."""
    p = val.select("prompt").distinct()
    both = p.join(train.select("prompt").distinct().withColumn("_in", F.lit(1)), "prompt", "left")
    return both.agg(F.count("*").alias("n_prompts_val"), F.count("_in").alias("n_shared")).withColumn("rate", F.coalesce(F.col("n_shared") / F.nullif("n_prompts_val", F.lit(0)), F.lit(0.0)))


def length_quantiles(pairs: DataFrame) -> DataFrame:
    """side, q05, q50, q95 of the number of characters, each the value at position floor(q n)."""
    sides = pairs.select(F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.length("chosen").alias("n")), F.struct(F.lit("rejected").alias("side"), F.length("rejected").alias("n")))).alias("x")).select("x.*")
    return quantiles(sides, "n", {"q05": floor_rule(0.05), "q50": floor_rule(0.5), "q95": floor_rule(0.95)}, ["side"])


def length_stats(pairs: DataFrame, near_equal: float = 0.1) -> DataFrame:
    """p_longer_wins, frac_near_equal."""
    a, b = F.length("chosen"), F.length("rejected")
    near = F.abs(a - b) / F.greatest(a, b, F.lit(1)) < F.lit(float(near_equal))
    return pairs.agg(F.coalesce(F.avg((a > b).cast("double")), F.lit(0.0)).alias("p_longer_wins"), F.coalesce(F.avg(near.cast("double")), F.lit(0.0)).alias("frac_near_equal"))


def pairwise_accuracy(pairs: DataFrame, score: Feature) -> DataFrame:
    """accuracy of a score of texts, ties for half; 0 without pairs."""
    return pairs.agg(F.coalesce(F.avg(half_credit(score(F.col("chosen")), score(F.col("rejected")))), F.lit(0.0)).alias("accuracy"))


def _named(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"))


def baseline_accuracies(pairs: DataFrame, features: dict[str, Feature] | None = None) -> DataFrame:
    """name, accuracy of every baseline, in one pass over the pairs."""
    features = features or BASELINES
    row = pairs.agg(*(F.coalesce(F.avg(half_credit(f(F.col("chosen")), f(F.col("rejected")))), F.lit(0.0)).alias(k) for k, f in features.items()))
    return row.select(F.explode(F.array(*(_named(k, F.col(k)) for k in features))).alias("x")).select("x.name", F.col("x.value").alias("accuracy"))


def best_baseline(accuracies: DataFrame, features: dict[str, Feature] | None = None) -> DataFrame:
    """name, score, direction of the baseline furthest from a half; of equal ones the first in order."""
    order = F.array_position(F.array(*(F.lit(k) for k in (features or BASELINES))), F.col("name"))
    key = F.struct(F.round(F.abs(F.col("accuracy") - 0.5), 12), -order)
    best = accuracies.agg(F.max_by(F.struct("name", "accuracy"), key).alias("b"))
    acc = F.col("b.accuracy")
    return best.select(F.col("b.name").alias("name"), F.greatest(acc, 1 - acc).alias("score"), F.when(acc < 0.5, "flipped").otherwise("direct").alias("direction"))


def surface_probes(pairs: DataFrame, probes: dict[str, Feature] | None = None) -> DataFrame:
    """name, p_chosen, p_rejected, gap, chi2 of every probe, in one pass; the largest gap first."""
    probes = probes or PROBES
    counted = pairs.agg(F.count("*").alias("_n"), *(F.count_if(f(F.col(side))).alias(f"{side}_{k}") for k, f in probes.items() for side in ("chosen", "rejected")))
    n = F.greatest(F.col("_n"), F.lit(1))
    each = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("name"), F.col(f"chosen_{k}").alias("c"), F.col(f"rejected_{k}").alias("r")) for i, k in enumerate(probes)))
    rows = counted.select("_n", F.explode(each).alias("x")).select("_n", "x.*", (F.col("x.c") / n).alias("p_chosen"), (F.col("x.r") / n).alias("p_rejected"))
    rows = rows.select("ord", "name", "p_chosen", "p_rejected", (F.col("p_chosen") - F.col("p_rejected")).alias("gap"), chi2(F.col("c"), F.col("_n") - F.col("c"), F.col("r"), F.col("_n") - F.col("r")).alias("chi2"))
    return rows.orderBy(F.abs("gap").desc(), "ord").drop("ord")


# --- bag of words --------------------------------------------------------------------------------------------------------


def split_pairs(pairs: DataFrame, test_frac: float = 0.2) -> DataFrame:
    """pairs with is_test, by a hash of the pair's id: the same pairs at any partitioning."""
    return pairs.withColumn("is_test", hash_unit(F.concat(F.lit("lexical "), F.col("pair_uid").cast("string"))) < test_frac)


def _side_tokens(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each pair, side and token, with its count in that text: repeats of a token meet before any shuffle."""
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(True).alias("is_chosen"), tokens(F.col("chosen")).alias("t")), F.struct(F.lit(False).alias("is_chosen"), tokens(F.col("rejected")).alias("t")))).alias("s"))
    return sides.select(*keys, "s.is_chosen", F.explode("s.t").alias("token"))


def token_log_odds(train: DataFrame, min_count: int = 2, alpha: float = 1.0) -> DataFrame:
    """token, n_chosen, n_rejected, log_odds for tokens that occur min_count times or more, smoothed by alpha."""
    counts = _side_tokens(train, []).groupBy("token").agg(F.count_if("is_chosen").alias("n_chosen"), F.count_if(~F.col("is_chosen")).alias("n_rejected")).where(F.col("n_chosen") + F.col("n_rejected") >= min_count)
    totals = counts.agg(F.sum("n_chosen").alias("tc"), F.sum("n_rejected").alias("tr"), F.count("*").alias("v"))
    rows = counts.crossJoin(F.broadcast(totals))  # one row
    part = lambda n, t: F.log((F.col(n) + alpha) / (F.col(t) + alpha * F.col("v")))
    return rows.select("token", "n_chosen", "n_rejected", (part("n_chosen", "tc") - part("n_rejected", "tr")).alias("log_odds"))


def lexical_probe(pairs: DataFrame, test_frac: float = 0.2, min_count: int = 2, alpha: float = 1.0) -> DataFrame:
    """n_train_pairs, n_test_pairs, vocab_size, accuracy (half credit for ties) of naive Bayes on tokens."""
    rows = split_pairs(pairs, test_frac)
    odds = checkpointed(token_log_odds(rows.where(~F.col("is_test")), min_count, alpha))  # read for its tokens and for their number
    test = rows.where("is_test")
    scored = _side_tokens(test, ["pair_uid"]).groupBy("pair_uid", "is_chosen", "token").agg(F.count("*").alias("n")).join(odds.select("token", "log_odds"), "token")
    sums = scored.groupBy("pair_uid").agg(F.sum(F.when(F.col("is_chosen"), F.col("n") * F.col("log_odds")).otherwise(0.0)).alias("c"), F.sum(F.when(~F.col("is_chosen"), F.col("n") * F.col("log_odds")).otherwise(0.0)).alias("r"))
    # sums in another order differ in their last bits; equal sums are ties
    tie = F.round("c", 9), F.round("r", 9)
    known = sums.agg(F.sum(half_credit(*tie)).alias("right"), F.count("*").alias("n_known"))
    counts = rows.agg(F.count_if(~F.col("is_test")).alias("n_train_pairs"), F.count_if("is_test").alias("n_test_pairs"))
    right = F.coalesce("right", F.lit(0.0)) + 0.5 * (F.col("n_test_pairs") - F.col("n_known"))  # pairs without a known token are ties
    whole = counts.crossJoin(known).crossJoin(odds.agg(F.count("*").alias("vocab_size")))  # one row each
    return whole.select(F.try_divide(right, "n_test_pairs").alias("accuracy"), "n_test_pairs", "n_train_pairs", "vocab_size")


def top_tokens(odds: DataFrame, k: int = 20) -> DataFrame:
    """side, token, log_odds rounded to 2 places: the k highest and the k lowest; equal ones in order of tokens."""
    key = F.round("log_odds", 9)
    high = odds.orderBy(key.desc(), "token").limit(k).select(F.lit("chosen").alias("side"), "token", "log_odds")
    low = odds.orderBy(key, "token").limit(k).select(F.lit("rejected").alias("side"), "token", "log_odds")
    return high.union(low).withColumn("log_odds", F.round("log_odds", 2))


# --- the report ----------------------------------------------------------------------------------------------------------


def audit(groups: DataFrame, pairs: DataFrame, val: DataFrame | None = None, ceiling: float = CEILING, min_pairs: int = 50, min_test: int = 100) -> DataFrame:
    """One row with every scalar of Tier 0."""
    base = baseline_accuracies(pairs)
    best = best_baseline(base).select(F.col("name").alias("baseline_best"), F.col("score").alias("baseline_best_acc"), F.col("direction").alias("baseline_direction"))
    wide = base.agg(*(F.max(F.when(F.col("name") == k, F.col("accuracy"))).alias(f"acc_{k}") for k in BASELINES))
    probe = surface_probes(pairs).limit(1).select(F.col("name").alias("probe_name"), F.col("gap").alias("probe_gap"))
    lexical = lexical_probe(pairs)
    status = F.when(F.col("n_train_pairs") + F.col("n_test_pairs") < min_pairs, "unavailable").when((F.col("vocab_size") == 0) | (F.col("n_test_pairs") == 0), "unavailable").when(F.col("n_test_pairs") < min_test, "approximate").otherwise("ok")
    lexical = lexical.withColumn("lexical_status", status).select("lexical_status", F.when(F.col("lexical_status") != "unavailable", F.col("accuracy")).alias("lexical_acc"), "vocab_size")
    leak = prompt_leakage(groups, val) if val is not None else groups.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_shared"), F.lit(0.0).alias("rate"))
    row = structure_stats(groups)
    keys = slice_cardinality(groups).agg(F.count("*").alias("n_slice_keys"))
    for other in (pairs.agg(F.count("*").alias("n_pairs")), length_stats(pairs), wide, best, probe, lexical, leak.select(F.col("n_shared").alias("leakage_prompts"), F.col("rate").alias("leakage_rate")), keys):
        row = row.crossJoin(other)  # one row each
    return row.withColumn("expected_ceiling", F.lit(float(ceiling)))


def audit_warnings(report: DataFrame) -> DataFrame:
    """ord, code, message of the rules that a report of audit() breaks."""
    c = F.col
    usable = c("lexical_status") != "unavailable"
    rules = [
        ("regime_mismatch", c("baseline_best_acc") > c("expected_ceiling"), F.format_string("baseline %s at %.3f is above the expected ceiling %.2f", "baseline_best", "baseline_best_acc", "expected_ceiling")),
        ("lexically_trivial", usable & (c("lexical_acc") > LEXICAL_BOUND), F.format_string("bag of words alone reaches %.3f", "lexical_acc")),
        ("trivial_model_wins", c("baseline_best_acc") > BASELINE_BOUND, F.format_string("baseline %s already reaches %.3f", "baseline_best", "baseline_best_acc")),
        ("length_imbalance", ~c("p_longer_wins").between(LONGER_LOW, LONGER_HIGH), F.format_string("the longer side wins in %.3f of the pairs", "p_longer_wins")),
        ("surface_shortcut", F.abs("probe_gap") > GAP_BOUND, F.format_string("probe %s has a gap of %.3f", "probe_name", "probe_gap")),
        ("leakage", c("leakage_prompts") > 0, F.format_string("%d prompts are in both splits", "leakage_prompts")),
        ("identical_sides", c("n_identical_sides") > 0, F.format_string("%d groups have equal responses", "n_identical_sides")),
        ("no_signal", c("n_all_tied") > 0, F.format_string("%d groups are fully tied", "n_all_tied")),
        ("empty_responses", c("n_empty_response") > 0, F.format_string("%d groups have a blank response", "n_empty_response")),
        ("lexical_not_run", ~usable, F.lit("the bag-of-words probe did not run")),
        ("no_slice_keys", c("n_slice_keys") == 0, F.lit("there are no slice keys")),
    ]
    each = F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"), text.alias("message"))) for i, (code, bad, text) in enumerate(rules)))
    return report.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("w")).select("w.*")
