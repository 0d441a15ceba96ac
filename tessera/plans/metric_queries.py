"""Queries of metrics, splits, tokens, vectors, minimal pairs, judgements and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import common_suffix, fill_template, split_constraints
from ..operators import judge as J
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import minimal as X
from ..operators import order as O
from ..operators import splits as S
from ..operators import tokens as K
from ..operators import vectors as V
from .audit_queries import BASELINE_SQL, PROBE_SQL, _sql
from .fixtures import PAIRS_SQL, SCORED_SQL, TRIPLES_SQL, pairs, scored, table, triples
from .registry import query


def _round(df, *keep, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes))


_SP = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_SOFT = lambda x: _SP.replace("{x}", x)
_ACC = "avg(case when r_chosen > r_rejected then 1 when r_chosen = r_rejected then 0.5 else 0 end)"
_PM = f"""count(*) as n_pairs, round({_ACC}, 6) as accuracy, round(sqrt({_ACC} * (1 - {_ACC}) / count(*)), 6) as accuracy_se, round(avg((r_chosen = r_rejected)::int), 6) as frac_ties, round(avg(r_chosen - r_rejected), 6) as mean_margin,
round(avg(r_chosen), 6) as mean_chosen, round(avg(r_rejected), 6) as mean_rejected, round(max(greatest(abs(r_chosen), abs(r_rejected))), 6) as abs_reward_max, round(avg({_SOFT('(r_rejected - r_chosen)')}), 6) as mean_loss,
round(quantile_cont(r_chosen - r_rejected, 0.1), 6) as p10_margin, round(quantile_cont(r_chosen - r_rejected, 0.5), 6) as median_margin, round(quantile_cont(r_chosen - r_rejected, 0.9), 6) as p90_margin"""
_SLICED = f"with {SCORED_SQL}, sliced as (select *, 'flag=' || flag as slice from scored union all select *, 'status=' || status from scored)"


@query(f"with {SCORED_SQL} select {_PM} from scored")
def pair_metrics(spark, sf_dir):
    return _round(M.pair_metrics(scored(spark, sf_dir)))


@query(f"{_SLICED} select slice, {_PM} from sliced group by slice")
def slice_metrics_reward(spark, sf_dir):
    return _round(M.slice_metrics(scored(spark, sf_dir)))


@query(f"{_SLICED} select 'all' as slice, {_PM} from scored union all select slice, {_PM} from sliced group by slice")
def eval_result(spark, sf_dir):
    return _round(M.eval_result(scored(spark, sf_dir)))


@query(f"with {SCORED_SQL} select uid, round({_SOFT('(0.5 - (r_chosen - r_rejected))')}, 6) as loss from scored")
def bt_loss(spark, sf_dir):
    return _round(M.bt_loss(scored(spark, sf_dir), 0.5).select("uid", "loss"))


_D = "(0.1 * (policy_chosen - ref_chosen) - 0.1 * (policy_rejected - ref_rejected))"
_SIG = f"(1 / (1 + exp({_D})))"
_DPO = f"""count(*) as n_pairs, round(avg({_SOFT('(-' + _D + ')')}), 6) as loss, round(avg(({_D} > 0)::int), 6) as accuracy, round(avg({_D}), 6) as delta_mean, round(avg(0.1 * (policy_chosen - ref_chosen)), 6) as reward_chosen, round(avg(0.1 * (policy_rejected - ref_rejected)), 6) as reward_rejected,
round(avg({_D}), 6) as reward_margin, round(avg(policy_chosen), 6) as policy_logp_chosen, round(avg(policy_rejected), 6) as policy_logp_rejected, round(avg(ref_chosen), 6) as ref_logp_chosen, round(avg(ref_rejected), 6) as ref_logp_rejected,
round(avg(policy_chosen - ref_chosen), 6) as logratio_chosen, round(avg(policy_rejected - ref_rejected), 6) as logratio_rejected, round(avg((policy_chosen < ref_chosen)::int), 6) as frac_winner_below_ref, round(avg((policy_rejected < ref_rejected)::int), 6) as frac_loser_below_ref,
round(avg(({_SIG} < 0.01)::int), 6) as frac_pairs_saturated, round(avg({_SIG}), 6) as grad_weight_mean"""


@query(f"with {SCORED_SQL} select {_DPO} from scored")
def dpo_preference_metrics(spark, sf_dir):
    return _round(M.dpo_metrics(scored(spark, sf_dir)))


@query(f"{_SLICED} select slice, {_DPO} from sliced group by slice")
def dpo_slice_metrics(spark, sf_dir):
    return _round(M.dpo_slice_metrics(scored(spark, sf_dir)))


@query(f"with {SCORED_SQL} select round(avg({_SOFT('(-' + _D + ')')}), 6) as preference_term, round(avg(policy_chosen / 7), 6) as sft_term, round(avg({_SOFT('(-' + _D + ')')}) - 0.25 * avg(policy_chosen / 7), 6) as loss from scored")
def dpo_loss(spark, sf_dir):
    return _round(M.dpo_loss(scored(spark, sf_dir).withColumn("n", F.lit(7)), 0.1, 0.25, "n"))


@query(f"with {SCORED_SQL} select round(max(abs(policy_chosen - ref_chosen)), 6) as max_dev_chosen, round(max(abs(policy_rejected - ref_rejected)), 6) as max_dev_rejected from scored")
def step_zero(spark, sf_dir):
    return _round(M.step_zero(scored(spark, sf_dir)))


@query(f"with {SCORED_SQL} (select 'worst' as side, uid, round(r_chosen - r_rejected, 6) as margin from scored order by r_chosen - r_rejected, uid limit 8) union all (select 'best', uid, round(r_chosen - r_rejected, 6) from scored order by r_chosen - r_rejected desc, uid limit 8)")
def t2_extremes(spark, sf_dir):
    return _round(M.margin_extremes(scored(spark, sf_dir)))


_REWARDS = "select l_orderkey * 10 + l_linenumber as uid, l_quantity / 50 as quantity, l_discount * 10 as discount from lineitem"


def _rewards(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    rows = x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"))
    return M.combine_rewards(rows, M.reward_weights(["quantity", "discount"], [3.0, -1.0], normalise=True))


@query(f"select uid, round(1.5 * quantity - 0.5 * discount, 6) as total from ({_REWARDS})")
def reward_combine(spark, sf_dir):
    return _round(_rewards(spark, sf_dir).select("uid", "total"))


@query(
    f"with r as (select *, 1.5 * quantity - 0.5 * discount as total from ({_REWARDS})) "
    + " union all ".join(f"select '{c}' as name, round(avg({c}), 6) as mean, round(min({c}), 6) as min, round(max({c}), 6) as max from r" for c in ("quantity", "discount", "total"))
)
def reward_report(spark, sf_dir):
    return _round(M.reward_report(_rewards(spark, sf_dir), ["quantity", "discount"]))


@query("select count(*) as n_samples, count(distinct conv_id)::bigint as n_prompts, round(avg(length(text)), 6) as mean_new_tokens, round(avg((trim(text) = '')::int), 6) as frac_empty from conversations where role = 'assistant' and text is not null")
def generation_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null").select(F.col("conv_id").alias("prompt"), F.col("text").alias("response"), F.length("text").alias("n_new_tokens"))
    return _round(M.generation_metrics(rows))


@query("select floor((o_orderkey - 1) / 500)::bigint * 500 + 500 as step, round(sum(o_totalprice * (o_custkey % 7 + 1)) / sum(o_custkey % 7 + 1), 4) as loss from orders group by 1")
def train_accumulators(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), (F.col("o_custkey") % 7 + 1).alias("batch"), F.col("o_totalprice").alias("loss"))
    return _round(M.train_accumulators(log, ["loss"], 500), digits=4)


@query(
    """with e as (select o_custkey as run, o_orderkey as step, o_totalprice as accuracy from orders), b as (select *, max(accuracy) over (partition by run order by step rows between unbounded preceding and 1 preceding) as before from e),
    good as (select * from b where before is null or accuracy > before) select run, max(accuracy) as best_metric, max(step)::bigint as best_step, null::bigint as stopped_at from good group by run"""
)
def checkpoint_select(spark, sf_dir):
    return M.checkpoint_select(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("accuracy")))


@query(
    """with c as (select user_id as run, event_id, ts, event_type = 'purchase' or event_type = 'error' as failed from events), g as (select *, sum(case when not failed then 1 else 0 end) over (partition by run order by ts, event_id rows unbounded preceding) as g from c),
    n as (select run, g, count(*) as n from g where failed group by run, g) select r.run, coalesce(max(n.n), 0)::bigint as longest from (select distinct run from c) r left join n using (run) group by r.run"""
)
def judge_consecutive_failures(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.struct("ts", "event_id").alias("at"), F.col("event_type").isin("purchase", "error").alias("failed"))
    return M.longest_failures(rows)


# --- splits ------------------------------------------------------------------------------------------------------------------

_U = "(('0x' || substr(sha256({t}), 1, 8))::bigint / 4294967296.0)"


@query(f"select doc_id, {_U.replace('{t}', 'text')} < 0.1::double as is_val from documents")
def split_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return S.assign_hash(d.select("doc_id", F.col("text").alias("prompt")), 0.1).select("doc_id", "is_val")


@query()
def split_random(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("prompt"))
    return S.assign_random(d, 0.2, seed=3).select("doc_id", "is_val")


@query("select doc_id, (row_number() over (partition by text, lang order by doc_id) - 1)::int as copy from documents")
def row_dedup(spark, sf_dir):
    return S.row_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id").select("doc_id", "copy")


_COPIES = "c as (select text as prompt, row_number() over (partition by text, lang order by doc_id) - 1 as copy from documents)"


@query(
    f"""with {_COPIES}, p as (select prompt, count(*) as n, count(*) filter (where {_U.replace('{t}', 'prompt')} < 0.1::double) as v, count(*) filter (where copy > 0) as d from c group by prompt)
    select sum(n)::bigint as n_rows, count(*) as n_prompts, sum(d)::bigint as n_exact_duplicate_rows, sum(n - v)::bigint as n_rows_train, sum(v)::bigint as n_rows_val, count(*) filter (where v < n) as n_prompts_train, count(*) filter (where v > 0) as n_prompts_val,
    count(*) filter (where v > 0 and v < n) as n_overlap_prompts, min(n) as rows_per_prompt_min, max(n) as rows_per_prompt_max from p"""
)
def split_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), "lang")
    return S.split_report(S.split_records(d, "doc_id", 0.1))


@query("select text as prompt, min(doc_id) as first from documents group by text order by first, text limit 25")
def gen_prompts(spark, sf_dir):
    return S.first_prompts(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt")), 25, "doc_id")


@query("select min(doc_id) as doc_id, sha256(text) as sha from documents group by text")
def unique_rows(spark, sf_dir):
    return S.unique_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("select distinct text as prompt from documents where doc_id % 2 = 0 intersect select distinct text from documents where doc_id % 2 = 1")
def prompt_intersect(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return d.where("doc_id % 2 = 0").select("prompt").intersect(d.where("doc_id % 2 = 1").select("prompt"))


@query("select r_regionkey::bigint as key, r_name as name, null::varchar as kind from region union all select n_nationkey::bigint, n_name, 'nation' from nation")
def union_files(spark, sf_dir):
    from ..sources.readers import union_files as union

    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("key"), F.col("r_name").alias("name"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return union([a, b])


# --- lookups -------------------------------------------------------------------------------------------------------------------


@query(f"with {SCORED_SQL} select uid, policy_chosen, round(0 - l_tax * 100, 9) as ref_chosen, round(0 - l_discount * 100, 9) as ref_rejected from scored join (select l_orderkey * 10 + l_linenumber as uid, l_tax, l_discount from lineitem) using (uid)")
def ref_cache_lookup(spark, sf_dir):
    s = scored(spark, sf_dir)
    cache = s.select("uid", F.round("ref_chosen", 9).alias("chosen"), F.round("ref_rejected", 9).alias("rejected"))
    return L.reference_lookup(s.select("uid", "policy_chosen"), cache)


@query("select sha256(text) as sha, max(case when doc_id % 3 = 0 then 'cache' else 'new' end) = 'new' and min(case when doc_id % 3 = 0 then 0 else 1 end) = 1 as embedded from documents group by 1")
def embed_cache_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = d.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("sha"), F.lit(False).alias("vector")).dropDuplicates(["sha"])
    return L.embed_missing(d.select("text"), cache, lambda rows: rows.select("sha", F.lit(True).alias("vector"))).select("sha", F.col("vector").alias("embedded"))


@query("select d.doc_id from documents d left join (select doc_id from labels where toxic = 0) l on d.doc_id = l.doc_id where l.doc_id is null")
def resume_anti(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    done = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").alias("error"), F.lit("m1").alias("model"))
    return J.resume(d, done, "doc_id", {"model": "m1"})


@query(
    """with p as (select p_partkey as id, p_size as size, log2(p_size::double) as l from part) select a.id as a, b.id as b from (select * from p where id % 50 = 0) a join p b on abs(a.l - b.l) <= 0.25 and a.id <> b.id and a.size <> b.size"""
)
def band_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("word"), F.log2(F.col("p_size").cast("double")).alias("log2"), F.col("p_size").alias("key"))
    words = p.where("word % 50 = 0").select(F.col("word").alias("w1"), F.col("key").alias("k1"), F.col("word").alias("w2"))
    return X.band_join(words, p, 0.25).select(F.col("w2").alias("a"), F.col("w").alias("b"))


# --- quantile conventions ----------------------------------------------------------------------------------------------------------


@query(
    """with o as (select o_orderpriority as k, o_totalprice as x from orders), s as (select k, list_sort(list(x)) as v, count(*) as n from o group by k)
    select k, v[least(floor(0.05::double * n)::int, n - 1) + 1] as floor05, round(v[floor(0.3::double * (n - 1))::int + 1] + (0.3::double * (n - 1) - floor(0.3::double * (n - 1))) * (v[ceil(0.3::double * (n - 1))::int + 1] - v[floor(0.3::double * (n - 1))::int + 1]), 6) as linear30,
    v[ceil(0.5::double * n)::int] as lower50, v[(n // 2)::int + 1] as upper50, v[round_even(0.9::double * (n - 1), 0)::int + 1] as banker90 from s"""
)
def quantile_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_totalprice").alias("x"))
    q = O.quantiles(rows, "x", {"floor05": O.floor_rule(0.05), "linear30": O.linear_rule(0.3), "lower50": O.lower_rule(0.5), "upper50": O.upper_middle_rule(), "banker90": O.banker_rule(0.9)}, ["k"])
    return q.withColumn("linear30", F.round("linear30", 6))


@query("select doc_id, row_number() over (order by n_chars desc, doc_id) + 4 as position from documents")
def assign_uids(spark, sf_dir):
    return O.with_index(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.col("n_chars").desc(), "doc_id"], "position", 5).select("doc_id", "position")


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 20")
def top_k_indices(spark, sf_dir):
    return O.top_k(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 20, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"))


# --- vectors ------------------------------------------------------------------------------------------------------------------------


@query("with u as (select embedding::double[] as v from embeddings) select count(*) as n, round((select list_sum(list_transform(list(s), lambda x: x * x)) from (select sum(v[i] / sqrt(list_dot_product(v, v))) as s from u, range(1, 65) t(i) group by i)) , 6) as total from u")
def unit_normalize(spark, sf_dir):
    rows = V.unit_normalise(table(spark, sf_dir, "embeddings").select("embedding"), "embedding")
    n = rows.agg(F.count("*").alias("n"))
    return _round(n.crossJoin(V._sum_vector(rows, "embedding").agg(F.sum(F.col("total") * F.col("total")).alias("total"))))


@query("with u as (select list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings), s as (select i, sum(v[i]) as s from u, range(1, 65) t(i) group by i), n as (select count(*) as n from u) select n, round((sum(s * s) - n) / (n * (n - 1)), 9) as mean_cosine from s, n group by n")
def mean_pairwise_cosine(spark, sf_dir):
    return _round(V.mean_pairwise_cosine(table(spark, sf_dir, "embeddings"), "embedding"), digits=9)


@query("with g as (select i, j, sum(e.embedding[i]::double * e.embedding[j]::double) as x from embeddings e, range(1, 65) a(i), range(1, 65) b(j) group by i, j) select (select count(*) from embeddings) as n, round(sum(case when i = j then x else 0 end) * sum(case when i = j then x else 0 end) / sum(x * x), 6) as effective_rank from g")
def participation_ratio(spark, sf_dir):
    return _round(V.participation_ratio(table(spark, sf_dir, "embeddings"), "embedding"))


@query()
def gram_spectrum(spark, sf_dir):
    values = V.spectrum(table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame([(i, round(float(x), 9)) for i, x in enumerate(values)], "position int, eigenvalue double")


@query()
def vendi_score(spark, sf_dir):
    return spark.createDataFrame([(round(V.vendi_score(V.spectrum(table(spark, sf_dir, "embeddings"), "embedding")), 6),)], "vendi double")


@query()
def embedding_health(spark, sf_dir):
    return _round(V.embedding_health(table(spark, sf_dir, "embeddings"), "embedding"))


_COS = lambda a, b: f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


@query(f"with {TRIPLES_SQL} select round(avg({_COS('p', 'c')}), 9) as cos_prompt_chosen, round(avg({_COS('p', 'r')}), 9) as cos_prompt_rejected, round(avg({_COS('p', 'c')}) - avg({_COS('p', 'r')}), 9) as relevance_gap, round(avg(({_COS('p', 'r')} < 0.2)::int), 9) as frac_rejected_offtopic from triples")
def grounding(spark, sf_dir):
    return _round(V.grounding(triples(spark, sf_dir), "p", "c", "r"), digits=9)


@query(f"with {TRIPLES_SQL}, s as (select round(c[1] - r[1], 12) as s from triples) select round(sum(case when a.s > -b.s then 1 when a.s = -b.s then 0.5 else 0 end) / pow((select count(*) from s), 2), 9) as auc from s a, s b")
def pairwise_auc(spark, sf_dir):
    return _round(V.pairwise_auc(triples(spark, sf_dir).select((F.get("c", F.lit(0)) - F.get("r", F.lit(0))).alias("s")), "s"), digits=9)


_NEAR = f"select a.vec_id as key, max({_COS('a.embedding::double[]', 'b.embedding::double[]')}) as best, count(*) filter (where {_COS('a.embedding::double[]', 'b.embedding::double[]')} > 0.4) as over from embeddings a, embeddings b where a.vec_id <> b.vec_id group by a.vec_id"


@query(f"select key, round(best, 6) as best, over from ({_NEAR})")
def blocked_cosine_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    return _round(V.nearest(e, e, "key", "v", 0.4))


@query()
def near_duplicates(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    return _round(V.near_duplicates(e.where("key % 4 <> 0"), e.where("key % 4 = 0"), "key", "v", 0.4))


@query()
def mmd_test(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _round(V.mmd_test(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "embedding", "vec_id"))


def _delta(spark, sf_dir):
    return triples(spark, sf_dir).withColumn("d", F.zip_with("c", "r", lambda x, y: x - y))


@query()
def delta_direction(spark, sf_dir):
    return V.delta_direction(_delta(spark, sf_dir), "d")


@query()
def top_directions(spark, sf_dir):
    return V.pc1_extremes(_delta(spark, sf_dir), "id", "d")


@query()
def linear_probe(spark, sf_dir):
    w = V.linear_probe(_delta(spark, sf_dir), "d")
    return spark.createDataFrame([(i, round(float(x), 5)) for i, x in enumerate(w)], "position int, weight double")


@query()
def t2_directions(spark, sf_dir):
    rows = _delta(spark, sf_dir)
    return _round(V.reward_directions(rows, "d", V.linear_probe(rows, "d")))


@query()
def separability(spark, sf_dir):
    rows = _delta(spark, sf_dir).withColumn("raw", F.lit(True)).withColumn("first_half", F.col("id") % 2 == 0).withColumn("all_matched", F.col("id") % 8 == 0)
    return V.separability(rows, ["raw", "first_half", "all_matched"], "d")


@query()
def diversity(spark, sf_dir):
    rows = triples(spark, sf_dir)
    e = rows.select(F.col("id").alias("key"), F.col("p").alias("v"))
    return _round(V.diversity(rows, {"prompt": "p", "chosen": "c", "rejected": "r"}, V.nearest(e, e, "key", "v", 0.95)))


_MASKS = " union all ".join(
    f"select 'match_{k}' as name, count(*) filter (where {e})::bigint as n from pairs"
    for k, e in [(k, f"({_sql(f, 'chosen')}) = ({_sql(f, 'rejected')})") for k, f in PROBE_SQL.items()]
    + [(k, f"abs({_sql(f, 'chosen')} - {_sql(f, 'rejected')}) / greatest(abs({_sql(f, 'chosen')}), abs({_sql(f, 'rejected')}), 1.0) < 0.1::double") for k, f in BASELINE_SQL.items()]
)


@query(f"with {PAIRS_SQL} select 'raw' as name, count(*) as n from pairs union all {_MASKS}")
def slice_masks(spark, sf_dir):
    rows, names = V.slice_masks(pairs(spark, sf_dir))
    names = names[:-1]
    row = rows.agg(*(F.count_if(n).alias(n) for n in names))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.*")


# --- tokens ----------------------------------------------------------------------------------------------------------------------------


def _ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("p"), F.transform(F.split("text", "e"), lambda w: F.length(w)).alias("r"))


_IDS = "ids as (select conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)::int) as p, list_transform(string_split(text, 'e'), lambda w: length(w)::int) as r from conversations where text is not null)"
_ENC = "enc as (select *, case when 32 - len(r) <= 0 then [] when len(p) > 32 - len(r) then p[len(p) - (32 - len(r)) + 1 :] else p end as q, r[1 : least(32, len(r))] as s from ids)"


@query(f"with {_IDS}, {_ENC} select conv_id, turn, array_to_string(q, ',') as prompt_ids, array_to_string(s, ',') as response_ids, len(r) <= 32 and len(p) > 32 - len(r) as prompt_truncated, len(r) > 32 as response_truncated from enc")
def dpo_encode(spark, sf_dir):
    e = K.encode_pair(F.col("p"), F.col("r"), 32)
    return _ids(spark, sf_dir).select("conv_id", "turn", *(F.array_join(e[c], ",").alias(c) for c in ("prompt_ids", "response_ids")), e["prompt_truncated"].alias("prompt_truncated"), e["response_truncated"].alias("response_truncated"))


@query(
    f"""with {_IDS}, {_ENC}, m as (select conv_id, max(len(q) + len(s)) as n from enc group by conv_id) select e.conv_id, turn, array_to_string(list_concat(q, s, list_transform(range(n - len(q) - len(s)), lambda i: 0)), ',') as input_ids,
    (len(q) + len(s))::int as attended, len(s)::int as completed, n::int as width from enc e join m using (conv_id)"""
)
def dpo_collate(spark, sf_dir):
    rows = _ids(spark, sf_dir)
    e = K.encode_pair(F.col("p"), F.col("r"), 32)
    rows = K.collate(rows.select("conv_id", "turn", e["prompt_ids"].alias("prompt_ids"), e["response_ids"].alias("response_ids")), "conv_id")
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.array_join("input_ids", ",").alias("input_ids"), total("attention_mask").alias("attended"), total("completion_mask").alias("completed"), F.size("completion_mask").alias("width"))


@query(f"with {_IDS}, {_ENC} select count(*) as n_rows, count(*) filter (where len(r) <= 32 and len(p) > 32 - len(r)) as n_prompt_truncated, count(*) filter (where len(r) > 32) as n_response_truncated, max(len(q) + len(s))::int as max_len_seen, min(len(s))::int as min_completion_len, coalesce(count(*) filter (where len(r) > 32) / count(*) > 0.05, false) as warn from enc")
def collate_report(spark, sf_dir):
    e = K.encode_pair(F.col("p"), F.col("r"), 32)
    return K.collate_report(_ids(spark, sf_dir).select(*(v.alias(k) for k, v in e.items())))


_LP = "lp as (select vec_id, list_transform(embedding::double[], lambda x: x - 1) as lp from embeddings)"


@query(f"with {_LP} select vec_id, round(list_sum(lp[4:]), 9) as total, round(list_sum(lp[4:]) / (len(lp) - 3), 9) as mean from lp")
def sequence_logprob(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") - 1).alias("lp"), F.transform("embedding", lambda x, i: (i >= 3).cast("int")).alias("mask"))
    return _round(e.select("vec_id", K.sequence_logprob(F.col("lp"), F.col("mask")).alias("total"), K.sequence_logprob(F.col("lp"), F.col("mask"), "mean").alias("mean")), digits=9)


@query("select vec_id, round(embedding[label + 1]::double - ln(list_sum(list_transform(embedding::double[], lambda x: exp(x)))), 9) as logp from embeddings")
def token_logprob(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return _round(e.select("vec_id", K.log_softmax_at(F.col("v"), F.col("label")).alias("logp")), digits=9)


@query(f"with {_IDS}, h as (select *, list_min(list_transform(list_filter(range(1, len(p) + 1), lambda i: p[i] in (2, 3, 5)), lambda i: i)) as halt from ids) select conv_id, turn, coalesce(halt - 1, len(p))::int as n_new, coalesce(p[halt] in (2, 3), false) as finished from h")
def count_new_tokens(spark, sf_dir):
    n, done = K.count_new_tokens(F.col("p"), [2, 3], 5)
    return _ids(spark, sf_dir).select("conv_id", "turn", n.cast("int").alias("n_new"), done.alias("finished"))


@query()
def dataset_digest(spark, sf_dir):
    return K.dataset_digest(pairs(spark, sf_dir))


@query("select s::int as step, round(case when s < 10 then (s + 1) / 10.0 else 0.5 * (1 + cos(pi() * least(greatest(s - 10, 0) / 90.0, 1))) end, 9) as cosine, round(case when s < 10 then (s + 1) / 10.0 else 1 - least(greatest(s - 10, 0) / 90.0, 1) end, 9) as linear from range(120) t(s)")
def lr_schedule(spark, sf_dir):
    rows = spark.range(120).select(F.col("id").cast("int").alias("step"))
    return _round(rows.select("step", K.schedule_factor(F.col("step"), "cosine", 10, 100).alias("cosine"), K.schedule_factor(F.col("step"), "linear", 10, 100).alias("linear")), digits=9)


@query("select c_custkey, (ceil(ceil(c_custkey / 16.0) / 4.0) * 3)::bigint as steps from customer")
def steps_plan(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", K.steps_plan(F.col("c_custkey"), 16, 4, 3).alias("steps"))


@query()
def epoch_batches(spark, sf_dir):
    return K.epoch_batches(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 1, 2, 64)


# --- couplets and judgements ---------------------------------------------------------------------------------------------------------------

_MARKS = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_END = lambda line: f"list_filter(regexp_split_to_array(lower(translate({line}, '{_MARKS}', '')), '\\s+'), lambda w: w <> '')[-1]"


@query(f"with l as (select doc_id, {_LINES} as lines from documents) select doc_id, len(lines)::int as n_lines, {_END('lines[1]')} as w1, {_END('lines[2]')} as w2 from l")
def couplet_lines(spark, sf_dir):
    return X.couplets(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", F.size("lines").alias("n_lines"), "w1", "w2")


@query(f"with l as (select {_LINES} as lines from documents), w as (select {_END('lines[2]')} as word from l where len(lines) >= 2) select word, count(*) as n, round(log2(count(*)::double), 9) as log2, right(word, 2) as key from w where word <> '' group by word")
def build_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("text")
    return _round(X.build_pool(d, "text", _rhymes(d)), digits=9)


def _rhymes(d):
    """A stand-in for a dictionary of rhymes: the last two letters."""
    return _rhymes_of(X.couplets(d, "text"))


def _rhymes_of(c):
    words = c.select(F.explode(F.array("w1", "w2")).alias("word")).where("word <> ''").distinct()
    return words.select("word", F.right("word", F.lit(2)).alias("key"))


@query(f"with l as (select doc_id, {_LINES} as lines from documents), e as (select doc_id, {_END('lines[1]')} as a, {_END('lines[2]')} as b from l where len(lines) >= 2) select doc_id, coalesce(list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda n: right(a, n::int) = right(b, n::int))), 0)::int as shared from e where a is not null and b is not null", name="common_suffix")
def common_suffix_length(spark, sf_dir):
    c = X.couplets(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").where("size(lines) >= 2 and w1 is not null and w2 is not null")
    return c.select("doc_id", common_suffix(F.col("w1"), F.col("w2")).alias("shared"))


def _fake(rows, column):
    return rows.withColumn("slot_logp", -F.length("w") / 1.0).drop("text") if column == "slot" else rows.withColumn("logp", -F.length("text") / 10.0).withColumn("eos_logp", F.lit(-1.0)).drop("text")


def _minimal(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.build_split(d, "doc_id", "text", _rhymes_of, lambda r: _fake(r, "slot"), lambda r: _fake(r, "score"))


@query(name="build_split")
def minimal_pairs(spark, sf_dir):
    return _minimal(spark, sf_dir)[0].select("doc_id", "near_miss", "replacement", F.round("gap", 6).alias("gap"))


@query()
def minimal_reasons(spark, sf_dir):
    return _minimal(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("select p_partkey, list_filter(list_transform(string_split(p_name || ' | ' || p_type || '||  ', '|'), lambda x: trim(x)), lambda x: x <> '') as constraints from part", name="split_constraints")
def split_constraints_of(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", split_constraints(F.concat("p_name", F.lit(" | "), "p_type", F.lit("||  "))).alias("constraints"))


@query("select p_partkey, 'Q: ' || p_name || '{response}' || chr(10) || 'A: ' || p_type || '.' as text from part")
def template_format(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fill_template("Q: {prompt}\nA: {response}.", prompt=F.concat("p_name", F.lit("{response}")), response=F.col("p_type")).alias("text"))


#: What is wrong with the replies of _judged, by key.
_ERROR = "case p_partkey % 6 when 2 then 'cannot be read as JSON' when 3 then '1 verdicts for 3 constraints' when 4 then 'a verdict is neither pass nor fail' when 5 then 'nothing came back' end"


def _judged(spark, sf_dir):
    """Replies of six kinds: sound, sound in fences with a failure and a flag, no JSON, a verdict short, a verdict that is text, none."""
    rows = J.constraints_of(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_name", F.lit(" | "), "p_type", F.lit(" | "), "p_brand").alias("c")), "c")
    reply = '{"constraints": [{"pass": true}, {"pass": %s, "reason": "r"}, {"pass": true}], "refused": %s}'
    kinds = [reply % ("true", "false"), "```json\n" + reply % ("false", "true") + "\n```", "no json", '{"constraints": [{"pass": true}]}', reply % ('"yes"', "false"), None]
    raw = F.get(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 6).cast("int"))
    return J.parse_replies(rows.withColumn("raw", raw), "raw", "constraints")


@query("select count(*) as judged, count(*) filter (where p_partkey % 6 > 1) as errors, count(*) filter (where p_partkey % 6 = 0) as all_pass, coalesce(sum(case p_partkey % 6 when 0 then 3 when 1 then 2 end), 0)::bigint as n_pass_sum, (3 * count(*) filter (where p_partkey % 6 < 2))::bigint as n_constraints_sum from part")
def judge_tally(spark, sf_dir):
    return J.tally(_judged(spark, sf_dir))


@query("select 'refused' as flag, count(*) filter (where p_partkey % 6 = 1) as n from part where p_partkey % 6 < 2 having count(*) > 0")
def judge_flags(spark, sf_dir):
    return J.flag_counts(_judged(spark, sf_dir))


@query("select conv_id, sum(length(text))::bigint as chars, count(*) as turns from conversations group by conv_id order by chars desc nulls last, conv_id limit 15")
def top_replacements(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"))
    return O.top_k(c, 15, F.col("chars").desc_nulls_last(), F.col("conv_id"))


@query("select p_brand, count(*) as n from part group by p_brand order by n desc, p_brand limit 15")
def top_values(spark, sf_dir):
    return X.top_values(table(spark, sf_dir, "part"), "p_brand")


# --- streams ---------------------------------------------------------------------------------------------------------------------------------


@query("select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def window_counts(spark, sf_dir):
    from ..streaming.ingest import windowed_counts

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_counts(e, "ts", "event_type", "value")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", F.round("total", 4).alias("total"))


# --- the ledger ------------------------------------------------------------------------------------------------------------------------------


@query()
def ledger(spark, sf_dir):
    from ..operators import audit as A
    from .fixtures import groups

    p = pairs(spark, sf_dir)
    report = A.audit(groups(spark, sf_dir), p)
    profile = spark.createDataFrame([(0.6, 0.55, 0.4, 0.2, 0.0)], "separability_raw double, separability_min double, frac_surface_controlled double, pc1_share double, prompt_overlap_frac double")
    run = M.pair_metrics(scored(spark, sf_dir)).select("accuracy", "accuracy_se", "n_pairs").crossJoin(
        spark.createDataFrame([(500, 900, True, 120.0, 1000, 0.7, 0.6, 0.3, 1.0, 1.5, None)], "best_step int, steps int, early_stopped boolean, wall_seconds double, total_steps int, cos_w_pc1 double, cos_w_mean_delta double, pc1_explained_frac double, rmax_first double, rmax_last double, shared_space boolean")
    )
    slices = M.slice_metrics(scored(spark, sf_dir)).select(F.col("slice").alias("name"), "n_pairs", "accuracy", "accuracy_se")
    return L.build_ledger(report, profile, run, slices)
