"""Loading, groups, pairs, splits, metrics, tokens and the rest, on literals."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, ContractError, DataError
from tessera.functions import numbers as N
from tessera.functions import rewards as R
from tessera.operators import audit as A
from tessera.operators import formats, judge, ledger, metrics, minimal, order, pairs, splits, tokens, vectors

KWAY = "prompt string, responses array<string>, ranking array<int>, scores array<double>"


def kway(spark, *rows):
    return spark.createDataFrame([(f"p{i}", [f"r{i}{j}" for j in range(k)], ranking, scores) for i, (k, ranking, scores) in enumerate(rows)], KWAY)


# --- formats ---


def test_layouts_and_reasons(spark):
    two = spark.createDataFrame([("q", "a", "b"), (None, "a", "b"), ("q", None, "b")], "prompt string, chosen string, rejected string")
    assert [(r.prompt, r.responses, r.reason) for r in formats.to_groups(two, "pairwise").collect()] == [("q", ["a", "b"], None), ("", ["a", "b"], None), ("q", ["", "b"], "a side is null")]
    arena = spark.createDataFrame([("q", "a", "b", w) for w in ("A", " model_b ", "tie", "0", "1", "zzz", "", None)] + [("q", None, "b", "a")], "prompt string, response_a string, response_b string, winner string")
    got = formats.to_groups(arena, "arena").collect()
    assert [r.reason for r in got] == [None, None, "tie", None, None, "the winner is none of the names known", "tie", "tie", "a response is null"]
    assert [r.responses for r in got][:2] == [["a", "b"], ["b", "a"]] and got[4].responses == ["b", "a"]


def test_kway_validation(spark):
    rows = kway(spark, (3, [2, 0, 1], None), (1, None, [1.0]), (2, [0], None), (2, [0, -1], None), (2, None, [1.0]), (2, None, [1.0, math.nan]), (2, None, None))
    got = [r.reason for r in formats.to_groups(rows, "kway").collect()]
    assert got == [None, "one response or none", "as many ranks as responses are needed", "a rank is below 0", "as many scores as responses are needed", "a score is not finite", None]
    strings = spark.createDataFrame([("p", ["a", None], ["2", "x"])], "prompt string, responses array<string>, ranking array<string>")
    row = formats.to_groups(strings, "kway").first()
    assert row.reason == "a rank is no whole number" and row.responses == ["a", ""]


def test_loading_refuses(spark):
    with pytest.raises(ConfigError):
        formats.FieldMap.of({"nope": "x"})
    with pytest.raises(DataError):
        formats.to_groups(spark.createDataFrame([("a",)], "chosen string"), "pairwise")
    with pytest.raises(ConfigError):
        formats.to_groups(spark.createDataFrame([("a",)], "chosen string"), "other")
    two = spark.createDataFrame([("q", "a", "b", "x", None)] * 9 + [("q", None, "b", "x", "s")], "prompt string, chosen string, rejected string, k string, l string")
    with pytest.raises(DataError):
        formats.load_groups(two, "pairwise")
    got = formats.load_groups(two, "pairwise", slice_keys=["k", "l"], max_drop_rate=0.1, start_uid=5)
    assert sorted(r.uid for r in got.collect()) == list(range(5, 14)) and got.first().slices == {"k": "x"}


# --- pairs ---


def test_policies_and_counts(spark):
    rnd = random.Random(1)
    data = [(k, [rnd.randint(0, 3) for _ in range(k)], None) for k in (2, 3, 5, 8)] + [(4, None, [1.0, 3.0, 3.0, 0.5]), (3, [1, 1, 1], None), (2, None, None), (3, [0, 1, 2], [5.0, 6.0, 7.0])]
    groups = formats.load_groups(kway(spark, *data), "kway", max_drop_rate=1.0)
    want = {p: set() for p in pairs.POLICIES}
    for uid, (k, ranking, scores) in enumerate(data):
        ranks = ranking or ([sum(t > s for t in scores) for s in scores] if scores else None)
        if ranks is None:
            continue
        levels = sorted(set(ranks))
        for i, j in itertools.product(range(k), repeat=2):
            if ranks[i] < ranks[j]:
                want["all_pairs"].add((uid, i, j))
                if ranks[i] == min(ranks):
                    want["best_vs_rest"].add((uid, i, j))
                if levels.index(ranks[j]) == levels.index(ranks[i]) + 1:
                    want["adjacent"].add((uid, i, j))
    counts = {r.uid: r for r in pairs.count_pairs(groups).collect()}
    for policy in pairs.POLICIES:
        got = pairs.to_pairs(groups, policy).collect()
        assert {(r.group_uid, r.chosen_idx, r.rejected_idx) for r in got} == want[policy] and len(got) == len(want[policy])
        for uid in counts:
            assert counts[uid][policy] == sum(w[0] == uid for w in want[policy])
    row = pairs.to_pairs(groups).where("group_uid = 4 and chosen_idx = 1 and rejected_idx = 3").first()
    assert row.margin_hint == 2.5 and row.pair_uid == 4_001_003
    some = pairs.to_pairs(groups, max_pairs=2, seed=3)
    assert some.groupBy("group_uid").count().agg(F.max("count")).first()[0] == 2
    assert some.collect() == pairs.to_pairs(groups.repartition(3), max_pairs=2, seed=3).orderBy("group_uid", "chosen_idx", "rejected_idx").collect() or sorted(some.collect()) == sorted(pairs.to_pairs(groups.repartition(3), max_pairs=2, seed=3).collect())
    with pytest.raises(ConfigError):
        pairs.to_pairs(groups, "best")
    flags = {r.uid: r for r in pairs.group_flags(groups).collect()}
    assert flags[4].ranks == [2, 0, 0, 3] and flags[4].best_index == 1 and flags[4].has_signal and not flags[5].has_signal and not flags[6].has_signal


# --- order ---


def test_quantile_rules(spark):
    rnd = random.Random(2)
    groups = {k: [rnd.choice([rnd.random(), 1.0, 2.0]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 7), ("d", 100))}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("e", None)], "k string, x double")
    q = order.quantiles(rows, "x", {"f": order.floor_rule(0.05), "l": order.linear_rule(0.3), "low": order.lower_rule(0.5), "up": order.upper_middle_rule(), "b": order.banker_rule(0.9)}, ["k"])
    got = {r.k: r for r in q.collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert got[k].f == s[min(int(0.05 * n), n - 1)] and got[k].low == s[max(math.ceil(0.5 * n) - 1, 0)] and got[k].up == s[n // 2] and got[k].b == s[round(0.9 * (n - 1))]
        assert got[k].l == pytest.approx(np.quantile(vs, 0.3))


def test_index_is_a_total_order(spark):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1009)).alias("k"), "id")
    got = order.with_index(rows, ["k", "id"], "i", 3).orderBy("i").collect()
    assert [r.i for r in got] == list(range(3, 1003)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


# --- numbers ---


def test_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in (-800.0, -1.0, 0.0, 2.5, 800.0)], "x double")
    for r in rows.select("x", N.softplus(F.col("x")).alias("s"), N.sigmoid(F.col("x")).alias("g")).collect():
        assert r.s == pytest.approx(np.logaddexp(0, r.x)) and r.g == pytest.approx(1 / (1 + math.exp(-r.x)) if r.x > -700 else 0)
    table = spark.createDataFrame([(10, 20, 30, 5), (0, 0, 3, 4), (2**40, 1, 1, 2**40)], "a long, b long, c long, d long")
    for r in table.select("*", N.chi2(*map(F.col, "abcd")).alias("x")).collect():
        below = (r.a + r.b) * (r.c + r.d) * (r.a + r.c) * (r.b + r.d)
        assert r.x == pytest.approx((r.a + r.b + r.c + r.d) * (r.a * r.d - r.b * r.c) ** 2 / below if below else 0)
    assert spark.range(1).select(N.hash_unit(F.lit("a"))).first()[0] == 0.7913742703385651


# --- tier 0 ---


def test_structure_and_warnings(spark):
    rows = spark.createDataFrame([("p", ["a", "a"], [0, 1]), ("p", ["a", "a"], [0, 1]), ("q", ["x", " "], [0, 0]), ("r", ["long answer", "s"], [0, 1])], "prompt string, responses array<string>, ranking array<int>")
    groups = formats.load_groups(rows, "kway", order=["prompt", F.col("responses")[0]])
    s = A.structure_stats(groups).first()
    assert (s.n_groups, s.n_unique_prompts, s.n_exact_duplicates, s.n_identical_sides, s.n_all_tied, s.n_empty_response) == (4, 3, 1, 2, 1, 1)
    report = A.audit(groups, pairs.to_pairs(groups), val=groups.where("prompt = 'p'"))
    codes = [r.code for r in A.audit_warnings(report).orderBy("ord").collect()]
    assert {"leakage", "identical_sides", "no_signal", "empty_responses", "lexical_not_run", "no_slice_keys"} <= set(codes)
    assert A.structure_stats(groups.limit(0)).first().n_groups == 0
    empty = A.surface_probes(pairs.to_pairs(groups).limit(0)).collect()
    assert len(empty) == 15 and all(r.chi2 == 0 and r.gap == 0 for r in empty)


# --- metrics ---


def test_pair_metrics_and_ties(spark):
    data = [(1.0, 0.0), (0.0, 1.0), (2.0, 2.0), (5.0, -1.0)]
    rows = spark.createDataFrame([(i, c, r, {"k": "v" if i < 2 else "", "z": None}) for i, (c, r) in enumerate(data)], "uid long, r_chosen double, r_rejected double, slices map<string,string>")
    m = metrics.pair_metrics(rows).first()
    assert m.accuracy == 0.625 and m.frac_ties == 0.25 and m.n_pairs == 4 and m.abs_reward_max == 5 and m.median_margin == 0.5
    assert m.mean_loss == pytest.approx(np.mean([np.logaddexp(0, r - c) for c, r in data]))
    assert [r.slice for r in metrics.slice_metrics(rows).collect()] == ["k=v"]
    assert metrics.pair_metrics(rows.limit(0)).count() == 0
    flat = {r.key: r.value for r in metrics.flatten_eval(metrics.eval_result(rows)).collect()}
    assert flat["eval/accuracy"] == 0.625 and flat["eval/k=v/n_pairs"] == 2
    log = rows.select(*(F.lit(0.0).alias(c) for c in ("policy_chosen", "policy_rejected", "ref_chosen", "ref_rejected")))
    assert metrics.dpo_metrics(log).first().accuracy == 0  # ties earn nothing
    for bad in (0, -1):
        with pytest.raises(ConfigError):
            metrics.dpo_metrics(log, bad)


def test_checkpoints(spark):
    rows = spark.createDataFrame([("a", s, x) for s, x in enumerate([0.5, 0.6, 0.6, 0.55, 0.59, 0.9])] + [("b", 0, 0.1)], "run string, step long, accuracy double")
    got = {r.run: r for r in metrics.checkpoint_select(rows, patience=3).collect()}
    assert (got["a"].best_step, got["a"].best_metric, got["a"].stopped_at) == (1, 0.6, 4) and got["b"].stopped_at is None
    assert {r.run: r.best_step for r in metrics.checkpoint_select(rows, min_delta=0.2).collect()}["a"] == 5


def test_rewards(spark):
    assert metrics.reward_weights(["a", "b"]) == {"a": 1.0, "b": 1.0} and metrics.reward_weights(["a", "b"], [3, 1], True) == {"a": 0.75, "b": 0.25}
    for bad in ((["a", "a"], None, False), (["a"], [math.inf], False), (["a", "b"], [1, -1], True), (["a"], [1, 2], False)):
        with pytest.raises(ConfigError):
            metrics.reward_weights(*bad)

    @R.reward_func(name="length")
    def score(prompts, responses):
        return [len(r) for r in responses]

    R.smoke_test(score)
    rows = spark.createDataFrame([("p", "abc"), ("p", None)], "p string, r string")
    assert [r[0] for r in rows.select(R.reward_column(score, F.col("p"), F.col("r"))).collect()] == [3.0, 0.0]
    with pytest.raises(ContractError):
        R.smoke_test(lambda p, r: [math.nan] * len(p))
    assert R.load_rewards(["math:sqrt"]) == [math.sqrt]


# --- splits ---


def test_splits_share_no_prompt(spark):
    rows = spark.createDataFrame([(i, f"p{i % 40}", f"t{i % 90}") for i in range(300)], "row long, prompt string, text string")
    for method in ("hash", "random"):
        s = splits.split_records(rows, "row", 0.2, method, seed=1, drop_exact_duplicates=False)
        report = splits.split_report(s).first()
        assert report.n_overlap_prompts == 0 and report.n_rows == 300 and report.n_prompts == 40
    val = {f"p{i}" for i in range(40) if int(hashlib.sha256(f"p{i}".encode()).hexdigest()[:8], 16) / 2**32 < 0.2}
    assert {r.prompt for r in splits.assign_hash(rows, 0.2).where("is_val").collect()} == val
    prompts = sorted({f"p{i}" for i in range(40)})
    chosen = {prompts[i] for i in np.random.default_rng(7).permutation(40)[:8]}
    assert {r.prompt for r in splits.assign_random(rows, 0.2, 7).where("is_val").collect()} == chosen
    with pytest.raises(ConfigError):
        splits.assign_hash(rows, 1.0)
    twice = rows.union(rows.withColumn("row", F.col("row") + 1000))
    assert splits.split_records(twice, "row", 0.2, drop_exact_duplicates=True).count() == rows.select("prompt", "text").distinct().count()


# --- tokens ---


def test_encode_within_budget(spark):
    for n_p, n_r, m in itertools.product((0, 1, 5, 9), (1, 4, 8, 12), (4, 8)):
        p, r = list(range(n_p)), list(range(100, 100 + n_r))
        row = spark.createDataFrame([(p, r)], "p array<int>, r array<int>").select(*(c.alias(k) for k, c in tokens.encode_pair(F.col("p"), F.col("r"), m).items())).first()
        room = m - n_r
        want = ([], r[:m], False, True) if room < 0 else (p[n_p - room :] if n_p > room else p, r, n_p > room, False)
        assert (row.prompt_ids, row.response_ids, row.prompt_truncated, row.response_truncated) == want


def test_collate_and_logprobs(spark):
    rows = spark.createDataFrame([(0, [1, 2], [3]), (0, [], [4, 5, 6, 7]), (1, [8], [9])], "b int, prompt_ids array<int>, response_ids array<int>")
    got = sorted(tokens.collate(rows, "b", 0).collect(), key=lambda r: r.input_ids)
    assert [(r.input_ids, r.attention_mask, r.completion_mask) for r in got] == [([1, 2, 3, 0], [1, 1, 1, 0], [0, 0, 1, 0]), ([4, 5, 6, 7], [1] * 4, [1] * 4), ([8, 9], [1, 1], [0, 1])]
    lp = spark.createDataFrame([([-1.0, -2.0, -3.0, -4.0], [1, 0, 1, 1])], "l array<double>, m array<int>").select(tokens.sequence_logprob(F.col("l"), F.col("m")), tokens.sequence_logprob(F.col("l"), F.col("m"), "mean")).first()
    assert lp[0] == -7 and lp[1] == -3.5
    ids = spark.createDataFrame([([5, 6, 2, 0],), ([5, 0, 2],), ([5, 6],)], "x array<int>")
    n, done = tokens.count_new_tokens(F.col("x"), [2], 0)
    assert [tuple(r) for r in ids.select(n, done).collect()] == [(2, True), (1, False), (2, False)]


def test_digest_depends_on_order_and_text(spark):
    rows = spark.createDataFrame([(i, "p", f"c{i}", "r") for i in range(50)], "pair_uid long, prompt string, chosen string, rejected string")
    d = tokens.dataset_digest(rows).first()[0]
    assert len(d) == 16 and d == tokens.dataset_digest(rows.repartition(3)).first()[0]
    assert d != tokens.dataset_digest(rows.withColumn("pair_uid", 49 - F.col("pair_uid"))).first()[0] and d != tokens.dataset_digest(rows.where("pair_uid < 49")).first()[0]
    b = tokens.epoch_batches(rows, "pair_uid", 1, 0, 8)
    assert sorted(r.position for r in b.collect()) == list(range(50)) and b.agg(F.max("batch")).first()[0] == 6


# --- vectors ---


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(0).normal(size=(120, 6)) + 0.4
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, v array<double>")


def test_spectra(cloud):
    x, rows = cloud
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    values = np.linalg.eigvalsh(u.T @ u / len(u))[::-1]
    assert np.allclose(vectors.spectrum(rows, "v"), values)
    assert vectors.vendi_score(values) == pytest.approx(np.exp(-(values * np.log(values)).sum()))
    c = u @ u.T
    assert vectors.mean_pairwise_cosine(rows, "v").first().mean_cosine == pytest.approx((c.sum() - len(u)) / (len(u) * (len(u) - 1)))
    raw = np.linalg.eigvalsh(x.T @ x)
    assert vectors.participation_ratio(rows, "v").first().effective_rank == pytest.approx(raw.sum() ** 2 / (raw**2).sum())
    assert vectors.embedding_health(rows, "v").first().status == "ok"
    assert vectors.embedding_health(rows.withColumn("v", F.transform("v", lambda a: a * 0)), "v").first().status == "degenerate"


def test_cosine_join_over_several_blocks(cloud, monkeypatch):
    x, rows = cloud
    monkeypatch.setattr(vectors, "BLOCK", 32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -np.inf)
    got = {r.key: r for r in vectors.nearest(rows, rows, "key", "v", 0.8).collect()}
    assert len(got) == len(x)
    for i in got:
        assert got[i].best == pytest.approx(c[i].max()) and got[i].over == (c[i] > 0.8).sum()
    r = vectors.near_duplicates(rows.where("key < 80"), rows.where("key >= 80"), "key", "v", 0.8).first()
    assert r.n_train == (c[:80, :80] > 0.8).sum() // 2 and r.n_cross == (c[:80, 80:] > 0.8).sum() and r.n_val == (c[80:, 80:] > 0.8).sum() // 2


def test_auc_with_ties(spark):
    for n, seed in ((1, 0), (7, 1), (60, 2)):
        s = np.random.default_rng(seed).integers(-3, 4, n).astype(float)
        want = np.mean([(a > -b) + 0.5 * (a == -b) for a in s for b in s])
        assert vectors.pairwise_auc(spark.createDataFrame([(v,) for v in s.tolist()], "s double"), "s").first().auc == pytest.approx(want)


def test_probe_minimises_its_objective(spark, cloud):
    x, rows = cloud
    w = vectors.linear_probe(rows, "v", l2=1.0)
    gradient = -(x.T @ (1 / (1 + np.exp(x @ w)))) + 2 * w
    assert np.abs(gradient).max() < 1e-3


def test_mmd(spark, cloud):
    x, rows = cloud
    same = vectors.mmd_test(rows.where("key % 2 = 0"), rows.where("key % 2 = 1"), "v", "key").first()
    moved = vectors.mmd_test(rows.where("key % 2 = 0"), rows.where("key % 2 = 1").withColumn("v", F.transform("v", lambda a: a + 2)), "v", "key").first()
    assert same.p_value > 0.05 > moved.p_value and moved.mmd2 > same.mmd2
    assert vectors.mmd_test(rows.limit(3), rows, "v", "key").first().status == "unavailable"


def test_separability(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(f"p{i % 90}", (rng.normal(size=4) + 1).tolist(), i % 3 == 0) for i in range(400)], "prompt string, d array<double>, third boolean").withColumn("raw", F.lit(True)).withColumn("all_matched", F.col("prompt") == "p1")
    got = vectors.separability(rows, ["raw", "third", "all_matched"], "d")
    by = {r.name: r for r in got.collect()}
    assert by["raw"].acc > 0.8 and by["raw"].status == "approximate" and by["all_matched"].status == "unavailable" and by["raw"].n_train + by["raw"].n_test == 400
    s = vectors.separability_summary(got, 400).first()
    assert s.separability_raw == by["raw"].acc and s.top_confound == "third" and s.status == "ok"


# --- the rest ---


def test_band_join_equals_a_scan(spark):
    rnd = random.Random(3)
    pool = [(f"w{i}", math.log2(rnd.randint(1, 500)), rnd.choice(["a", "b", "", None])) for i in range(80)]
    rows = spark.createDataFrame(pool, "word string, log2 double, key string")
    words = spark.createDataFrame([("w1", "a", "w2"), ("w5", "b", "w9")], "w1 string, k1 string, w2 string")
    at = {w: (x, k) for w, x, k in pool}
    for band in (0.3, 1.0):
        want = {(a, b, w) for a, k1, b in words.collect() for w, x, k in pool if abs(x - at[b][0]) <= band and w not in (a, b) and k and k != k1}
        assert {(r.w1, r.w2, r.w) for r in minimal.band_join(words, rows, band).collect()} == want


def test_band_join_is_dealt_over_tasks(spark):
    """However few bytes the sides have: the result has the product of their rows."""
    rows = spark.range(9000).selectExpr("concat('w', id) as word", "cast(id % 3 as double) / 10 as log2", "cast(id % 7 as string) as key").coalesce(1)
    words = rows.where("log2 = 0 and word rlike '00$'").selectExpr("'-' as w1", "key as k1", "word as w2")
    joined = minimal.band_join(words, rows, 0.5).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(1 for n in joined if n) > 1 and sum(joined) == sum(1 for a in range(300, 9000, 300) for k in range(7) if a % 7 != k for _ in range(k, 9000, 7))


def test_band_join_shuffles_each_word_once(spark):
    """A word that asks was shuffled once for every part of the buckets that it meets, so the shuffle grew as the pairs."""
    rows = spark.range(44000).selectExpr("cast(id as string) as word", "if(id < 40000, 0, 0.45d) as log2", "if(id = 43999, 'y', 'x') as key")
    words = rows.where("log2 > 0").selectExpr("'-' as w1", "key as k1", "word as w2")
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = stages(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = written()
    assert minimal.band_join(words, rows, 0.25).count() == 2 * 3999
    assert written() - before <= 2 * (44000 + 4000) + 1000  # once for the join with the logarithms too


def test_band_join_of_odd_sides(spark):
    """No word asks, none can be asked, logarithms and keys that are missing or not finite, a band of nothing; words and keys of any type."""
    pool = [("a", 1.0, 1), ("b", 1.0, 2), ("c", 1.0, None), ("d", None, 2), ("e", math.inf, 2), ("f", math.nan, 2), ("g", 1.25, 2), ("h", -1.0, 1), ("i", -1.1, 2)]
    rows = spark.createDataFrame(pool, "word string, log2 double, key long")
    words = rows.selectExpr("'-' as w1", "key as k1", "word as w2")
    for band, want in ((0.0, {("a", "b"), ("b", "a")}), (0.25, {("a", "b"), ("b", "a"), ("a", "g"), ("g", "a"), ("h", "i"), ("i", "h")})):
        assert {(r.w2, r.w) for r in minimal.band_join(words, rows, band).collect()} == want
    assert minimal.band_join(words.limit(0), rows, 0.25).count() == 0 == minimal.band_join(words, rows.limit(0), 0.25).count()


def test_logarithms_of_a_pool_are_the_nearest_doubles(spark):
    rows = spark.range(1, 64).selectExpr("explode(array_repeat(concat('a b\n', 'w', id), int(id))) as text")
    pool = minimal.build_pool(rows, "text", spark.createDataFrame([], "word string, key string")).collect()
    assert len(pool) == 63 and all(r.log2 == math.log2(r.n) and r.word == f"w{r.n}" for r in pool)


def test_judge_replies(spark):
    replies = ['{"constraints": [{"pass": true, "reason": "x"}, {"pass": false}], "refused": true}', '```json\n{"constraints": [{"pass": true}, {"pass": true}]}\n```', "no", '{"constraints": [{"pass": true}]}', '{"constraints": [{"pass": "yes"}, {"pass": true}]}', '{"other": 1}', None]
    rows = spark.createDataFrame([(i, r, ["a", "b"]) for i, r in enumerate(replies)], "idx long, raw string, c array<string>")
    got = judge.parse_replies(rows, "raw", "c").orderBy("idx").collect()
    assert [r.n_pass for r in got] == [1, 2, None, None, None, None, None] and [r.all_pass for r in got][:2] == [False, True]
    assert got[0].flags == {"refused": True} and got[0].verdicts[1].constraint == "b"
    assert [bool(r.error) for r in got] == [False, False, True, True, True, True, True]
    t = judge.tally(judge.parse_replies(rows, "raw", "c")).first()
    assert (t.judged, t.errors, t.all_pass, t.n_pass_sum, t.n_constraints_sum) == (7, 5, 1, 3, 4)
    done = judge.parse_replies(rows, "raw", "c").withColumn("model", F.lit("m"))
    assert judge.resume(rows, done, "idx", {"model": "m"}).count() == 5
    with pytest.raises(DataError):
        judge.resume(rows, done, "idx", {"model": "other"})
    with pytest.raises(ConfigError):
        judge.prompt_text("{prompt}", F.lit(""), F.array(F.lit("")), F.lit(""))


def test_reference_cache(spark):
    p = spark.createDataFrame([(1,), (2,)], "uid long")
    cache = spark.createDataFrame([(1, -1.0, -2.0)], "uid long, chosen double, rejected double")
    assert ledger.reference_lookup(p.where("uid = 1"), cache).first().ref_rejected == -2
    with pytest.raises(Exception, match="no reference for 2"):
        ledger.reference_lookup(p, cache).collect()
    with pytest.raises(ContractError):
        ledger.check_cache({"fingerprint": "a"}, "b", "d", "sum")
    space = {"model_name": "m", "pooling": "mean", "max_length": 8}
    assert ledger.shared_space(space | {"template": "{response}"}, space) and not ledger.shared_space(space, space)


def test_texts_of_other_than_two_lines_do_not_travel(spark):
    """Those that have no two lines are cut from the rows that are stored and joined, and still have their reason."""
    rows = spark.createDataFrame([(1, "the cat\na hat"), (2, "word " * 1000), (3, "a\nb\nc"), (4, None), (5, "of cat\nno dog")], "doc_id long, text string")
    asked = []

    def rhymes(c):
        asked.append({r.doc_id: (r.n_lines, r.lines, r.w1, r.w2) for r in c.collect()})
        return c.selectExpr("explode(array(w1, w2)) as word").where("word <> ''").distinct().selectExpr("word", "right(word, 2) as key")

    fake = lambda name: lambda r: r.withColumn(name, F.lit(-1.0)).withColumn("eos_logp", F.lit(0.0)).drop("text") if name == "logp" else r.withColumn(name, F.lit(-1.0))
    pairs, reasons = minimal.build_split(rows, "doc_id", "text", rhymes, fake("slot_logp"), fake("logp"), negatives=1)
    assert {r.doc_id: r.reason for r in reasons.collect()} == {1: None, 2: "not two lines", 3: "not two lines", 4: "no rhyme", 5: "no rhyme"}
    assert asked[0][2][:2] == (1, None) and asked[0][3] == (3, None, "a", "b") and asked[0][1] == (2, ["the cat", "a hat"], "cat", "hat")
    assert [(r.doc_id, r.replacement) for r in pairs.collect()] == [(1, "b")]
