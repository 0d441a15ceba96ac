"""Queries of single operators: scans and sinks, group flags, features one by one, seams, tiers 1 and 2."""

from __future__ import annotations

import itertools
import uuid

import pandas as pd
from pyspark.sql import functions as F

from .. import config
from ..errors import ConfigError, DataError
from ..functions import numbers as N
from ..functions import rewards as R
from ..functions import text as T
from ..operators import audit as A
from ..operators import chat as C
from ..operators import formats
from ..operators import judge as J
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import minimal as X
from ..operators import pairs as P
from ..operators import seams
from ..operators import splits as S
from ..operators import tokens as K
from ..operators import vectors as V
from ..session import checkpoint_dir
from ..sources import readers, sinks
from .audit_queries import _HASH, BASELINE_SQL, PROBE_SQL, _sql
from .fixtures import PAIRS_SQL, SCORED_SQL, TRIPLES_SQL, groups, kway, pairs, scored, table, triples
from .metric_queries import _ACC, _COS, _END, _ERROR, _LINES, _U, _delta, _judged, _rhymes, _round
from .registry import ORACLES, query

# --- features one by one -----------------------------------------------------------------------------------------------------


def _feature(name, f, form, digits):
    def run(spark, sf_dir):
        value = f(F.col("text"))
        return table(spark, sf_dir, "documents").select("doc_id", (F.round(value, 9) if digits else value).alias("value"))

    expression = _sql(form, "text")
    query(f"select doc_id, {f'round({expression}, 9)' if digits else expression} as value from documents", name)(run)


for _name, _f in T.BASELINES.items():
    _feature(_name, _f, BASELINE_SQL[_name], True)
for _name, _f in T.PROBES.items():
    _feature(_name, _f, PROBE_SQL[_name], False)


# --- scans and sinks: a table goes out and comes back ----------------------------------------------------------------------------

_NATION = "select n_nationkey, n_name, n_regionkey from nation"
_NATION_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"


def _folder(spark, kind):
    return f"{checkpoint_dir(spark)}/tessera/{kind}-{uuid.uuid4().hex}"


def _nation(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query(_NATION)
def scan_parquet(spark, sf_dir):
    return readers.scan(spark, f"{sf_dir}/nation.parquet", _NATION_SCHEMA).select("n_nationkey", "n_name", "n_regionkey")


@query(_NATION)
def scan_jsonl(spark, sf_dir):
    path = _folder(spark, "jsonl")
    sinks.sink_records(_nation(spark, sf_dir), path)
    return readers.scan_jsonl(spark, path, _NATION_SCHEMA).drop("file", "row")


@query(_NATION)
def sink_records(spark, sf_dir):
    path = _folder(spark, "records")
    sinks.sink_records(_nation(spark, sf_dir), path)
    return spark.read.schema(_NATION_SCHEMA).json(path)


@query(f"{_NATION} union all {_NATION}")
def sink_jsonl_append(spark, sf_dir):
    path = _folder(spark, "append")
    for _ in range(2):
        sinks.sink_append(_nation(spark, sf_dir), path)
    return readers.scan_jsonl(spark, path, _NATION_SCHEMA).drop("file", "row")


@query(_NATION)
def scan_json(spark, sf_dir):
    path = _folder(spark, "json")
    rows = _nation(spark, sf_dir).agg(F.collect_list(F.struct("*")).alias("data"))  # the 25 nations
    rows.select(F.to_json(F.struct("data"))).coalesce(1).write.text(path)
    return readers.scan_json(spark, path, _NATION_SCHEMA, "data")


@query("select n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey from nation")
def scan_csv(spark, sf_dir):
    path = _folder(spark, "csv")
    _nation(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return readers.scan_csv(spark, path, ["n_nationkey", "n_name", "n_regionkey"])


@query("select r_regionkey::bigint as k, r_name as v from region")
def scan_memory(spark, sf_dir):
    return readers.scan_memory(spark, [{"k": r.r_regionkey, "v": r.r_name} for r in table(spark, sf_dir, "region").collect()], "k bigint, v string")


@query("select r_regionkey::bigint as k, r_name as v from region")
def scan_dataset(spark, sf_dir):
    class Rows:
        column_names = ["k", "v"]

        def to_pandas(self):
            return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("v")).toPandas()

    return readers.scan_dataset(spark, Rows(), "k bigint, v string")


@query("select n_nationkey::bigint as step, n_regionkey / 2.0::double as t, n_name as name from nation")
def scan_metrics(spark, sf_dir):
    path = _folder(spark, "metrics")
    _nation(spark, sf_dir).select(F.col("n_nationkey").alias("step"), (F.col("n_regionkey") / 2).alias("t"), F.col("n_name").alias("name")).write.json(path)
    return readers.scan_metrics(spark, path).select("step", "t", F.col("metrics")["name"].alias("name"))


@query()
def file_sha256(spark, sf_dir):
    return readers.file_digests(spark, f"{sf_dir}/nation.parquet").select("length", "sha256")


@query()
def report_to_dict(spark, sf_dir):
    return A.structure_stats(groups(spark, sf_dir)).select(F.to_json(F.struct("*")).alias("report"))


# --- groups and pairs ------------------------------------------------------------------------------------------------------------


@query(f"with {PAIRS_SQL} select uid, max(k) as k, false as has_ranking, true as has_scores, max(rnk) > 0 as has_signal, min(idx) filter (where rnk = 0)::int as best_index from members group by uid")
def group_k(spark, sf_dir):
    return P.group_flags(groups(spark, sf_dir)).select("uid", F.col("k").cast("bigint").alias("k"), "has_ranking", "has_scores", "has_signal", "best_index")


@query(f"with {PAIRS_SQL} select uid, min(idx) filter (where rnk = 0)::int as best_index from members group by uid")
def best_index(spark, sf_dir):
    return P.group_flags(groups(spark, sf_dir)).select("uid", "best_index")


@query(f"with {PAIRS_SQL} select uid, max(rnk) > 0 as has_signal from members group by uid")
def has_signal(spark, sf_dir):
    return P.group_flags(groups(spark, sf_dir)).select("uid", "has_signal")


@query(f"with {PAIRS_SQL} select uid, idx::int as idx, case when uid % 2 = 0 then (k - 1 - idx)::int else rnk::int end as rnk from members")
def effective_ranking(spark, sf_dir):
    g = groups(spark, sf_dir)
    given = F.when(F.col("uid") % 2 == 0, F.transform("responses", lambda x, i: F.size("responses") - 1 - i))
    return g.select("uid", F.posexplode(P.effective_ranking(given, F.col("scores"))).alias("idx", "rnk"))


@query(f"with {PAIRS_SQL} select uid, lvl::int as level, count(*) as n from members group by uid, lvl")
def rank_buckets(spark, sf_dir):
    g = P.group_flags(groups(spark, sf_dir)).select("uid", F.explode("ranks").alias("r"), F.array_sort(F.array_distinct("ranks")).alias("levels"))
    return g.groupBy("uid", F.array_position("levels", F.col("r")).cast("int").alias("level")).agg(F.count("*").alias("n"))


@query(f"with {PAIRS_SQL} select pair_uid, margin_hint from pairs")
def margin_hint(spark, sf_dir):
    return pairs(spark, sf_dir).select("pair_uid", "margin_hint")


@query("select l_orderkey * 1000000 + (l_linenumber - 1) * 1000 + l_linenumber as pair_uid from lineitem")
def pair_uid(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(P.pair_uid(F.col("l_orderkey"), F.col("l_linenumber") - 1, F.col("l_linenumber")).alias("pair_uid"))


@query(f"with {PAIRS_SQL} select group_uid, count(*) as n from pairs where rlvl = clvl + 1 group by group_uid")
def groups_to_pairs(spark, sf_dir):
    return P.to_pairs(groups(spark, sf_dir), "adjacent").groupBy("group_uid").agg(F.count("*").alias("n"))


@query("with l as (select d.source || '/' || cast(floor(d.doc_id / 200) as bigint) as prompt from documents d join labels l using (doc_id)) select prompt, count(*)::int as k, count(*) >= 2 as whole from l group by prompt")
def fmt_kway(spark, sf_dir):
    g = formats.to_groups(kway(spark, sf_dir), "kway_scores")
    return g.select("prompt", F.size("responses").alias("k"), F.col("reason").isNull().alias("whole"))


@query("select p_partkey, try_cast(split_part(p_type, ' ', 1) as int) is null as bad, p_size as number from part")
def num_list_cast(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.array(F.split("p_type", " ")[0], F.col("p_size").cast("string")).alias("x"))
    cast = formats.number_list(d, "x", "int")
    return d.select("p_partkey", F.exists(cast, lambda v: v.isNull()).alias("bad"), F.get(cast, F.lit(1)).alias("number"))


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 1 else 2 end as n, o_orderpriority as priority from orders")
def extract_slices(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey")).alias("odd"))
    s = formats.extract_slices(["o_orderpriority", "odd"])
    return o.select("o_orderkey", F.size(s).alias("n"), s["o_orderpriority"].alias("priority"))


@query("select p_partkey, p_name as chosen, p_type as rejected, 0 as first, 1 as second from part")
def from_pairwise(spark, sf_dir):
    g = formats.to_groups(table(spark, sf_dir, "part").select("p_partkey", F.lit("").alias("prompt"), F.col("p_name").alias("chosen"), F.col("p_type").alias("rejected")), "pairwise")
    r, k = F.col("responses"), F.col("ranking")
    return g.select("p_partkey", F.get(r, F.lit(0)).alias("chosen"), F.get(r, F.lit(1)).alias("rejected"), F.get(k, F.lit(0)).alias("first"), F.get(k, F.lit(1)).alias("second"))


@query("select p_partkey, p_name as label, 'given' as how from part")
def field_map(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("good"), F.col("p_type").alias("bad"))
    g = formats.to_groups(d, "pairwise_implicit", formats.FieldMap.of({"chosen": "good", "rejected": "bad"}))
    return g.select("p_partkey", F.get("responses", F.lit(0)).alias("label"), F.lit("given").alias("how"))


@query(
    """with tables(name, columns) as (values ('sides', ['prompt', 'chosen', 'rejected']), ('no prompt', ['chosen', 'rejected']), ('lists', ['prompt', 'responses', 'scores']), ('unscored', ['prompt', 'responses']), ('arena', ['prompt', 'response_a', 'response_b', 'winner'])),
    layouts(layout, needed, either) as (values ('pairwise', ['prompt', 'chosen', 'rejected'], false), ('pairwise_implicit', ['chosen', 'rejected'], false), ('kway', ['prompt', 'responses'], true), ('kway_scores', ['prompt', 'responses', 'scores'], false), ('kway_ranking', ['prompt', 'responses', 'ranking'], false), ('arena', ['prompt', 'response_a', 'response_b', 'winner'], false))
    select name, layout, list_has_all(columns, needed) and (not either or list_has_any(columns, ['ranking', 'scores'])) as fits from tables, layouts"""
)
def validate_columns(spark, sf_dir):
    tables = {"sides": "prompt chosen rejected", "no prompt": "chosen rejected", "lists": "prompt responses scores", "unscored": "prompt responses", "arena": "prompt response_a response_b winner"}
    out = []
    for name, columns in tables.items():
        df = table(spark, sf_dir, "region").select(*(F.col("r_name").alias(c) for c in columns.split()))
        for layout in (*formats.REQUIRED, *formats.ALIASES):
            try:
                formats.validate_columns(df, layout, formats.FieldMap())
                out.append((name, layout, True))
            except DataError:
                out.append((name, layout, False))
    return spark.createDataFrame(out, "name string, layout string, fits boolean")


_G = f"with {PAIRS_SQL}, g as (select uid, any_value(prompt) as prompt, list(text order by idx) as texts, min(score) = max(score) as tied, bool_or(trim(text) = '') as blank from members group by uid)"


@query(f"{_G} select (count(*) - count(distinct (prompt, texts)))::bigint as n from g")
def exact_duplicates(spark, sf_dir):
    return A.structure_stats(groups(spark, sf_dir)).select(F.col("n_exact_duplicates").alias("n"))


@query(f"{_G} select count(*) as n from g where len(list_distinct(texts)) < len(texts)")
def identical_sides(spark, sf_dir):
    return A.structure_stats(groups(spark, sf_dir)).select(F.col("n_identical_sides").alias("n"))


@query(f"{_G} select count(*) as n from g where tied")
def all_tied(spark, sf_dir):
    return A.structure_stats(groups(spark, sf_dir)).select(F.col("n_all_tied").alias("n"))


@query(f"{_G} select count(*) as n from g where blank")
def empty_response(spark, sf_dir):
    return A.structure_stats(groups(spark, sf_dir)).select(F.col("n_empty_response").alias("n"))


@query(f"with {PAIRS_SQL} select round(avg(case when length(chosen) > length(rejected) then 1 when length(chosen) = length(rejected) then 0.5 else 0 end), 9) as accuracy from pairs")
def pairwise_accuracy(spark, sf_dir):
    return _round(A.pairwise_accuracy(pairs(spark, sf_dir), lambda t: F.length(t)), digits=9)


@query(
    f"""with {PAIRS_SQL}, t as (select true as c, unnest(regexp_extract_all(lower(chosen), '[a-z0-9'']+|\\n')) as token from pairs union all select false, unnest(regexp_extract_all(lower(rejected), '[a-z0-9'']+|\\n')) from pairs)
    select token, count(*) filter (where c) as n_chosen, count(*) filter (where not c) as n_rejected from t group by token having count(*) >= 3"""
)
def token_counts(spark, sf_dir):
    return A.token_log_odds(pairs(spark, sf_dir), min_count=3).select("token", "n_chosen", "n_rejected")


@query("select o_orderkey, round(case when a * b * c * d = 0 then 0 else n * (w * z - x * y) * (w * z - x * y) / (a * b * c * d) end, 6) as chi2 from (select *, w + x as a, y + z as b, w + y as c, x + z as d, w + x + y + z as n from (select o_orderkey, (o_orderkey % 7)::double as w, (o_custkey % 5)::double as x, (o_orderkey % 3)::double as y, (o_custkey % 11)::double as z from orders))")
def chi2_2x2(spark, sf_dir):
    m = lambda c, k: F.col(c) % k
    return _round(table(spark, sf_dir, "orders").select("o_orderkey", N.chi2(m("o_orderkey", 7), m("o_custkey", 5), m("o_orderkey", 3), m("o_custkey", 11)).alias("chi2")))


# --- lookups ------------------------------------------------------------------------------------------------------------------------


@query(f"select doc_id, {_HASH.replace('{t}', 'source')} < 0.3::double as is_val from documents")
def split_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    marks = S.assign_hash(d.select("source").distinct(), 0.3, "source")
    return d.join(marks, "source").select("doc_id", "is_val")


@query("select d.doc_id, 'left' as what from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and coalesce(l.toxic, 0) = 0) union all select null, 'refused'")
def settings_guard(spark, sf_dir):
    """What a run with the settings of its results has left, errors again; and that one with others is refused."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit("m").alias("judge"), F.when(F.col("toxic") != 0, "failed").alias("error"))
    left = J.resume(docs, done, "doc_id", {"judge": "m"}).select("doc_id", F.lit("left").alias("what"))
    try:
        J.resume(docs, done, "doc_id", {"judge": "other"})
    except DataError:
        return left.union(spark.createDataFrame([(None, "refused")], "doc_id long, what string"))
    return left


@query(f"with {TRIPLES_SQL} select id, round(p[1], 9) as p, round(c[1], 9) as c, round(r[1], 9) as r from triples")
def positional_zip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("id"), F.pmod("vec_id", F.lit(3)).alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    whole = e.groupBy("id").agg(F.countDistinct("k").alias("n")).where("n = 3").select("id")
    views = {name: e.where(F.col("k") == k).join(whole, "id") for k, name in enumerate("pcr")}
    return _round(V.zip_views(views, "id").select("id", *(F.get(v, F.lit(0)).alias(v) for v in "pcr")), digits=9)


@query(
    """with n as (select avg((p_size > 20)::int) as acc, avg((p_size > 25)::int) as base, count(*) as pairs from part), s as (select 'len_' || p_brand as name, avg((p_size > 20)::int) as acc from part group by p_brand), w as (select min(acc) as worst from s)
    select 0 as ord, case when acc >= base - 0.005 then 'confirmed: at the surface ceiling' else 'below the surface ceiling' end as verdict from n
    union all select 1, case when worst >= acc - 0.02 then 'survives length control' else 'drops on length-controlled pairs' end from n, w union all select 2, case when worst >= 0.98 then 'holds on every matched slice' else 'read the slices' end from w
    union all select 3, 'spaces differ: not comparable' union all select 4, case when max(l_tax) > min(l_tax) * 1.1 then 'confirmed' else 'not observed' end from lineitem
    union all select 5, case when avg((p_size = 7)::int) = 0 then 'free of leakage' else 'prompts leak' end from part union all select 6, 'full budget'"""
)
def stamp_join(spark, sf_dir):
    """The ledger from receipts of one row that are made from tables."""
    p, part = F.col("p_size"), table(spark, sf_dir, "part")
    share = lambda c: F.avg(c.cast("int"))
    fixed = lambda **kw: [F.lit(v).alias(k) for k, v in kw.items()]
    audit = part.agg(share(p > 25).alias("baseline_best_acc")).select("*", *fixed(baseline_best="a", acc_char_length=0.5, p_longer_wins=0.5, frac_near_equal=0.1))
    profile = part.agg(share(p == 7).alias("prompt_overlap_frac")).select("*", *fixed(separability_raw=0.6, separability_min=0.5, frac_surface_controlled=0.4, pc1_share=0.2))
    run = part.agg(share(p > 20).alias("accuracy"), F.count("*").alias("n_pairs")).crossJoin(table(spark, sf_dir, "lineitem").agg(F.min("l_tax").cast("double").alias("rmax_first"), F.max("l_tax").cast("double").alias("rmax_last")))
    run = run.select("*", *fixed(accuracy_se=0.01, best_step=5, steps=9, early_stopped=False, wall_seconds=1.0, total_steps=9, cos_w_pc1=0.7, cos_w_mean_delta=0.6, pc1_explained_frac=0.3, shared_space=False))
    slices = part.groupBy(F.concat(F.lit("len_"), "p_brand").alias("name")).agg(F.count("*").alias("n_pairs"), share(p > 20).alias("accuracy"), F.lit(0.01).alias("accuracy_se"))
    return L.build_ledger(audit, profile, run, slices).select("ord", "verdict")


# --- metrics --------------------------------------------------------------------------------------------------------------------------


@query(f"with {SCORED_SQL}, m as (select 'cheap' as name, * from scored where r_chosen < 3 union all select 'large', * from scored where r_rejected > 2.5) select name, count(*) as n_pairs, round({_ACC}, 6) as accuracy, round(sqrt({_ACC} * (1 - {_ACC}) / count(*)), 6) as accuracy_se from m group by name having count(*) >= 50")
def slice_accuracy(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("cheap", F.col("r_chosen") < 3).withColumn("large", F.col("r_rejected") > 2.5)
    return _round(M.saturation_slices(s, ["cheap", "large"]))


@query(f"select *, 'all' as slice from ({ORACLES['dpo_preference_metrics']}) union all by name select * from ({ORACLES['dpo_slice_metrics']})")
def dpo_evaluate(spark, sf_dir):
    s = scored(spark, sf_dir)
    return _round(M.dpo_metrics(s).withColumn("slice", F.lit("all")).unionByName(M.dpo_slice_metrics(s)))


@query("select * from (values ('share', 'a', 0.75), ('share', 'b', 0.25), ('given', 'a', 3.0), ('given', 'b', -1.0), ('none', 'a', 1.0), ('none', 'b', 1.0), ('twice the name', 'refused', null), ('one short', 'refused', null), ('sum of 0', 'refused', null)) t(what, name, weight)".replace("0.75", "0.75::double"))
def reward_weights(spark, sf_dir):
    cases = {"share": (["a", "b"], [3, 1], True), "given": (["a", "b"], [3, -1], False), "none": (["a", "b"], None, False), "twice the name": (["a", "a"], None, False), "one short": (["a", "b"], [1], False), "sum of 0": (["a", "b"], [1, -1], True)}
    out = []
    for what, (names, weights, share) in cases.items():
        try:
            out += [(what, k, float(v)) for k, v in M.reward_weights(names, weights, share).items()]
        except ConfigError:
            out.append((what, "refused", None))
    return spark.createDataFrame(out, "what string, name string, weight double")


@query("select count(*) as rows_out, round(avg(l_tax - l_discount), 6) as mean_gap, round(list_sort(list(l_tax - l_discount))[(count(*) // 2)::int + 1], 6) as median_gap, round(avg((l_tax - l_discount > 0)::int), 6) as frac_rejected_more_likely, round(avg(l_quantity), 6) as mean_eos_gap from lineitem")
def minimal_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_tax") - F.col("l_discount")).alias("gap"), F.col("l_quantity").alias("eos_gap"))
    return _round(X.minimal_report(rows))


@query(
    """with c as (select *, lead(role) over w as r1, lead(text) over w as t1 from conversations window w as (partition by conv_id order by turn)), q as (select conv_id * 1000 + turn as id, text as prompt, t1 as a from c where role = 'user' and r1 = 'assistant' and text is not null and t1 is not null)
    select id, case when trim(a) = trim(prompt) then 'identical' end as reason, 2 as n_constraints, 'a' as constraint_family from q"""
)
def chat_to_pair(spark, sf_dir):
    return _chats(spark, sf_dir).select("id", "reason", "n_constraints", "constraint_family")


def _chats(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("r1", F.lead("role").over(w)).withColumn("t1", F.lead("text").over(w)).where("role = 'user' and r1 = 'assistant' and text is not null and t1 is not null")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    user = message("user", F.col("text"))
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("prompt"), F.array(user, message("assistant", F.col("t1"))).alias("chosen"), F.array(user, message("assistant", F.col("text"))).alias("rejected"), F.array(F.lit("a: x"), F.lit(" b ")).alias("constraints"))
    return C.chat_to_pair(rows)


@query()
def tulu_histograms(spark, sf_dir):
    made = _chats(spark, sf_dir).where("reason is null")
    return C.histograms(made).select("kind", "value", "n").union(C.word_percentiles(made).select(F.lit("words p50").alias("kind"), F.col("field").alias("value"), F.col("p50").cast("bigint").alias("n")))


# --- tier 1 and 2 ------------------------------------------------------------------------------------------------------------------------


@query(f"with {PAIRS_SQL} select pair_uid from pairs order by {_HASH.replace('{t}', "('0 ' || pair_uid)")}, pair_uid limit 100")
def profile_sample(spark, sf_dir):
    return P.uniform_sample(pairs(spark, sf_dir), "pair_uid", 100, 0).select("pair_uid")


@query("select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9'']+|\\n'))::double as total from documents")
def embed(spark, sf_dir):
    e = V.hash_embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 16)
    return e.select("doc_id", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"with {PAIRS_SQL} select pair_uid, (len(regexp_extract_all(lower(chosen), '[a-z0-9'']+|\\n')) - len(regexp_extract_all(lower(rejected), '[a-z0-9'']+|\\n')))::double as delta from pairs")
def embed_views(spark, sf_dir):
    p = pairs(spark, sf_dir)
    for side in ("chosen", "rejected"):
        p = V.hash_embed(p, side, 8, f"e_{side}")
    return p.select("pair_uid", F.aggregate(F.zip_with("e_chosen", "e_rejected", lambda a, b: a - b), F.lit(0.0), lambda s, x: s + x).alias("delta"))


@query("select unnest(range(23))::int as ord, unnest([" + ", ".join(f"'{k}'" for k in ["raw", *(f"match_{k}" for k in (*PROBE_SQL, *BASELINE_SQL)), "all_matched"]) + "]) as name")
def slice_specs(spark, sf_dir):
    """The names of all slices, in their order."""
    return spark.createDataFrame(list(enumerate(V.slice_masks(pairs(spark, sf_dir))[1])), "ord int, name string")


@query("select doc_id, len(list_distinct(string_split(text, ' ')))::bigint as n from documents where text is not null")
def memo(spark, sf_dir):
    @F.pandas_udf("long")
    def distinct_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(set(t.split(" "))))

    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return seams.memoised(docs, "text", lambda t: t.withColumn("n", distinct_words("text"))).select("doc_id", "n")


@query(f"with {TRIPLES_SQL} select id, " + _HASH.replace("{t}", "('0 ' || prompt)") + " < 0.2::double as is_test from triples")
def prompt_split(spark, sf_dir):
    return V.prompt_split(triples(spark, sf_dir)).select("id", "is_test")


@query(f"with {TRIPLES_SQL} select id, round(list_dot_product(list_transform(range(1, 65), lambda i: c[i] - r[i]), list_transform(range(1, 65), lambda i: i / 64.0::double)), 9) as score from triples")
def probe_scores(spark, sf_dir):
    w = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i / F.lit(64.0))
    return _round(_delta(spark, sf_dir).select("id", N.dot(F.col("d"), w).alias("score")), digits=9)


_D2 = "list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double)))"


@query(f"select a.vec_id as key, round(sum(exp(-0.5 * {_D2})), 6) as total from embeddings a, embeddings b where a.vec_id <> b.vec_id group by a.vec_id")
def rbf_kernel(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    return _round(V.kernel_sums(e, e, "key", "v", 0.5))


@query(
    f"""with k as (select a.vec_id % 2 as x, b.vec_id % 2 as y, exp(-0.5 * {_D2}) as k from embeddings a, embeddings b where a.vec_id <> b.vec_id), n as (select count(*) filter (where vec_id % 2 = 0) as m, count(*) filter (where vec_id % 2 = 1) as k from embeddings)
    select round((select sum(k) from k where x = 0 and y = 0) / (n.m * (n.m - 1)) + (select sum(k) from k where x = 1 and y = 1) / (n.k * (n.k - 1)) - 2 * (select sum(k) from k where x = 0 and y = 1) / (n.m * n.k), 9) as mmd2 from n"""
)
def mmd2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    return _round(V.mmd2(e.where("key % 2 = 0"), e.where("key % 2 = 1"), "key", "v", 0.5), digits=9)


@query()
def distribution_shift(spark, sf_dir):
    t = triples(spark, sf_dir)
    return V.distribution_shift(t.where("id % 4 <> 0"), t.where("id % 4 = 0"), {"prompt": "p", "chosen": "c", "rejected": "r"}, "id", min_rows=20)


@query(
    f"""with r as (select p_partkey, p_size / 50.0 as f, p_partkey % 4 as k, p_size as s from part), rules as (
      select p_partkey, 0 as ord, 'surface_by_construction' as code from r where f < {V.CONTROLLED} union all select p_partkey, 1, 'easy_without_shortcuts' from r where k <> 0 and f > {V.CEILING} union all select p_partkey, 2, 'large_confound' from r where 1 - f > {V.CONFOUND}
      union all select p_partkey, 3, 'one_axis' from r where f / 2 > {V.ONE_AXIS} union all select p_partkey, 4, 'rejected_off_topic' from r where f / 3 > {V.OFFTOPIC} union all select p_partkey, 5, 'semantic_leakage' from r where k > 0
      union all select p_partkey, 6, 'low_diversity' from r where f / 4 < {V.DIVERSE} union all select p_partkey, 7, 'shift_not_meaningful' from r where k = 3) select * from rules"""
)
def profile_warnings(spark, sf_dir):
    f, k = F.col("p_size") / 50.0, F.col("p_partkey") % 4
    report = table(spark, sf_dir, "part").select(
        "p_partkey", f.alias("frac_surface_controlled"), F.when(k != 0, f).alias("separability_min"), (1 - f).alias("top_confound_drop"), (f / 2).alias("mean_pairwise_cosine"), (f / 3).alias("frac_rejected_offtopic"), k.alias("n_cross"), (f / 4).alias("effective_sample_ratio"),
        F.when(k == 3, "not_applicable").otherwise("ok").alias("shift_status"),
    )
    return V.profile_warnings(report, ["p_partkey"])


@query("select o_custkey, count(*) as n, case when count(*) < 5 then 'unavailable' when count(*) < 12 then 'approximate' else 'ok' end as status from orders group by o_custkey")
def status_gate(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("status", V.status_gate(F.col("n"), 5, 12))


@query(f"with {TRIPLES_SQL} select id, round(list_dot_product(c, p), 9) as r_chosen, round(list_dot_product(r, p), 9) as r_rejected from triples")
def t2_collect(spark, sf_dir):
    return _round(triples(spark, sf_dir).select("id", N.dot(F.col("c"), F.col("p")).alias("r_chosen"), N.dot(F.col("r"), F.col("p")).alias("r_rejected")), digits=9)


@query("with l as (select o_custkey as run, o_orderkey as line, o_totalprice as loss from orders) select run, count(*) as n_steps_logged, arg_min(loss, line) as loss_first, arg_max(loss, line) as loss_last from l group by run")
def t2_curves(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("line"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"), F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("abs_reward_max"))
    return M.run_curves(log).select("run", "n_steps_logged", "loss_first", "loss_last")


@query("select a as same_model, b as same_length, c as bare, a and b and c as shared from (values (true), (false)) x(a), (values (true), (false)) y(b), (values (true), (false)) z(c)")
def shared_space(spark, sf_dir):
    out = []
    for a, b, c in itertools.product((True, False), repeat=3):
        run = {"model_name": "m" if a else "n", "pooling": "mean", "max_length": 8 if b else 9, "template": "{response}" if c else "{prompt} {response}"}
        out.append((a, b, c, L.shared_space(run, {"model_name": "m", "pooling": "mean", "max_length": 8})))
    return spark.createDataFrame(out, "same_model boolean, same_length boolean, bare boolean, shared boolean")


# --- tokens ----------------------------------------------------------------------------------------------------------------------------


@query("with t as (select conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)::int) as ids from conversations where text is not null) select conv_id, turn, array_to_string(ids[1:16], ',') as ids, len(ids) > 16 as truncated from t")
def pair_collate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text")
    return K.tokenise(c, ["text"], _word_lengths, 16).select("conv_id", "turn", F.array_join("text_ids", ",").alias("ids"), F.col("text_truncated").alias("truncated"))


def _word_lengths(texts):
    return [[len(w) for w in t.split(" ")] for t in texts]


@query("with t as (select p_partkey, list_transform(string_split(p_name, ' '), lambda w: length(w)::int) as a, list_transform(string_split(p_type, ' '), lambda w: length(w)::int) as b from part) select p_partkey, array_to_string(list_concat(a, list_transform(range(greatest(len(a), len(b)) - len(a)), lambda i: 0)), ',') as a, array_to_string(list_concat(b, list_transform(range(greatest(len(a), len(b)) - len(b)), lambda i: 0)), ',') as b from t")
def pad_join(spark, sf_dir):
    p = K.tokenise(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], _word_lengths, 1000)
    p = K.pad_join(p, "p_name_ids", "p_type_ids")
    return p.select("p_partkey", F.array_join("p_name_ids", ",").alias("a"), F.array_join("p_type_ids", ",").alias("b"))


@query("select vec_id, round((embedding[1]::double + embedding[3]::double) / 2, 9) as mean, round(embedding[1]::double, 9) as cls, round(embedding[3]::double, 9) as last from embeddings")
def pool_hidden(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    states = F.transform(F.slice("embedding", 1, 4), lambda x: F.array(x.cast("double")))
    mask = F.array(*(F.lit(m) for m in (1, 0, 1, 0)))
    return _round(e.select("vec_id", *(F.get(V.pool(states, mask, how), F.lit(0)).alias(how) for how in ("mean", "cls", "last"))), digits=9)


@query("select vec_id, round(list_sum(embedding::double[]) * 0.5 + 0.25, 9) as reward from embeddings")
def reward_head(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return _round(e.select("vec_id", (N.dot(F.col("embedding"), F.array_repeat(F.lit(0.5), 64)) + 0.25).alias("reward")), digits=9)


@query("select substr(sha256('m' || chr(0) || 'sum'), 1, 16) as fingerprint union all select substr(sha256('ms' || chr(0) || 'um'), 1, 16)")
def ref_fingerprint(spark, sf_dir):
    return spark.createDataFrame([(K.fingerprint("m", "sum"),), (K.fingerprint("ms", "um"),)], "fingerprint string")


@query("select p_partkey, -length(p_name)::double as ref_chosen, -length(p_type)::double as ref_rejected from part")
def build_ref_cache(spark, sf_dir):
    """Scores of all pairs by a model's seam, stored, and looked up by id."""
    path = _folder(spark, "cache")
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("").alias("prompt"), F.col("p_name").alias("chosen"), F.col("p_type").alias("rejected"))
    made = seams.score_pairs(p, lambda prompts, responses: [-len(r) for r in responses])
    made.select("p_partkey", F.col("r_chosen").alias("chosen"), F.col("r_rejected").alias("rejected")).write.parquet(path)
    return L.reference_lookup(p.select("p_partkey"), spark.read.parquet(path), "p_partkey")


@query("select p_partkey, length(p_name)::double as reward from part")
def udf_reward(spark, sf_dir):
    @R.reward_func(name="length")
    def length(prompts, responses):
        return [len(r) for r in responses]

    R.smoke_test(length)
    return table(spark, sf_dir, "part").select("p_partkey", R.reward_column(length, F.col("p_type"), F.col("p_name")).alias("reward"))


@query("select doc_id, length(text)::varchar || ' first' as response from documents where doc_id % 3 = 0 union all select doc_id, length(text)::varchar || ' second' from documents where doc_id % 3 <> 0")
def generate_resumable(spark, sf_dir):
    """A run over a third of the prompts, taken up by one over all: what the first wrote stays."""
    path = _folder(spark, "generations")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    write = lambda word: lambda prompts, k: [f"{len(p)} {word}" for p in prompts]
    seams.generate_resumable(docs.where("doc_id % 3 = 0"), path, "doc_id", write("first"))
    return seams.generate_resumable(docs, path, "doc_id", write("second")).select("doc_id", "response")


# --- scalars -----------------------------------------------------------------------------------------------------------------------------


@query("select o_orderkey, round(1 / (1 + exp(-(o_totalprice - 100000) / 50000)), 9) as p from orders")
def sigmoid(spark, sf_dir):
    return _round(table(spark, sf_dir, "orders").select("o_orderkey", N.sigmoid((F.col("o_totalprice") - 100000) / 50000).alias("p")), digits=9)


@query(f"select doc_id, round({_HASH.replace('{t}', 'text')}, 12) as u from documents")
def hash_unit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(N.hash_unit(F.col("text")), 12).alias("u"))


@query("select doc_id, sha256(text) as sha from documents")
def sha256_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(f"select doc_id, {_END('text')} as word from documents")
def last_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.last_word(F.col("text")).alias("word"))


@query(f"with l as (select {_LINES} as lines from documents), w as (select {_END('lines[1]')} as word from l union select {_END('lines[2]')} from l) select word, right(word, 2) as key from w where word <> ''")
def rhyme_key(spark, sf_dir):
    return _rhymes(table(spark, sf_dir, "documents").select("text"))


@query(f"with l as (select doc_id, {_LINES} as lines from documents), e as (select doc_id, lines, {_END('lines[1]')} as a, {_END('lines[2]')} as b from l) select doc_id, coalesce(len(lines) = 2 and a <> b and right(a, 2) = right(b, 2), false) as rhymes from e")
def couplet_rhymes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.couplet_rhymes(X.couplets(d, "text"), _rhymes(d)).select("doc_id", "rhymes")


@query("select p_partkey, case when p_size % 6 >= 3 then '3+' else (p_size % 6)::varchar end as bucket from part")
def near_miss_bucket(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.near_miss_bucket(F.col("p_size") % 6).alias("bucket"))


@query("select p_partkey, regexp_replace(p_name, '[^ ]+$', '') || 'word!' as text from part")
def replace_end(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.replace_end(F.concat("p_name", F.lit("!")), F.lit("word")).alias("text"))


@query("select p_partkey, p_name as text from part")
def strip_fences(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_fences(F.concat(F.lit("```json\n"), "p_name", F.lit("\n```"))).alias("text"))


@query(f"select p_partkey, case when p_partkey % 6 = 0 then 3 when p_partkey % 6 = 1 then 2 end::int as n_pass, case when p_partkey % 6 = 0 then true when p_partkey % 6 = 1 then false end as all_pass, {_ERROR} as error from part")
def parse_reply(spark, sf_dir):
    return _judged(spark, sf_dir).select("p_partkey", "n_pass", "all_pass", "error")


@query("select p_partkey, 'Prompt: ' || p_name || chr(10) || '1. ' || p_name || chr(10) || '2. ' || p_type || chr(10) || 'Response: r' as prompt from part")
def judge_prompt_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.array("p_name", "p_type").alias("c"))
    return rows.select("p_partkey", J.prompt_text("Prompt: {prompt}\n{constraints}\nResponse: {response}", F.col("p_name"), F.col("c"), F.lit("r")).alias("prompt"))


@query(f"select doc_id, {_U.replace('{t}', 'text')} < 0.25::double as is_val, (row_number() over (partition by text, lang order by doc_id) - 1)::int as copy from documents")
def split_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), "lang")
    return S.split_records(d, "doc_id", 0.25).select("doc_id", "is_val", "copy")


@query(f"select count(*) filter (where v) as n_val, count(*) filter (where not v) as n_train from (select {_U.replace('{t}', 'text')} < 0.1::double as v from documents)")
def resplit_files(spark, sf_dir):
    base = _folder(spark, "split")
    split = S.split_records(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), "lang"), "doc_id", 0.1)
    for name, keep in (("val", F.col("is_val")), ("train", ~F.col("is_val"))):
        sinks.sink_records(split.where(keep).select("prompt", "lang"), f"{base}/{name}")
    n = lambda name: spark.read.schema("prompt string, lang string").json(f"{base}/{name}").agg(F.count("*").alias(f"n_{name}"))
    return n("val").crossJoin(n("train"))


# --- seams, contracts, snapshots and whole reports ------------------------------------------------------------------------------------------


@query("select p_partkey, length(p_name)::double as r_chosen, length(p_type)::double as r_rejected from part")
def model_scorer(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("").alias("prompt"), F.col("p_name").alias("chosen"), F.col("p_type").alias("rejected"))
    return seams.score_pairs(p, lambda prompts, responses: [len(r) for r in responses]).select("p_partkey", "r_chosen", "r_rejected")


@query("select p_partkey, k::int as sample, p_name || ' ' || k as response from part, range(3) t(k)")
def generate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("prompt"))
    return seams.generate(p, "p_partkey", lambda prompts, k: [f"{x} {k}" for x in prompts], 3)


@query("select vec_id, round(list_sum(embedding::double[]) * 0.5 + 1, 9) as r_chosen, round(list_sum((embedding::double[])[1:8]) * 0.25, 9) as r_rejected from embeddings")
def reward_model(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return _round(e.select("vec_id", seams.reward_head(F.col("embedding"), [0.5] * 64, 1.0).alias("r_chosen"), seams.reward_head(F.slice("embedding", 1, 8), [0.25] * 8).alias("r_rejected")), digits=9)


@query("select vec_id, round(embedding[1]::double, 6) as first from embeddings where abs(embedding[1]) <= 1")
def tensor_contracts(spark, sf_dir):
    from ..operators import contracts

    e = contracts.need_unique(contracts.need_columns(table(spark, sf_dir, "embeddings"), vec_id="bigint"), "vec_id")
    e = contracts.need_length(e, "embedding", 64).select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))
    return _round(contracts.need_range(contracts.need_finite(e, "first"), "first", -1, 1))


@query("select n_nationkey, n_name from nation where n_nationkey % 2 = 0")
def checkpoint_store(spark, sf_dir):
    from ..sources.snapshots import Snapshots

    store = Snapshots(spark, _folder(spark, "snapshots"), keep_last=1)
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for step, metric in ((1, 0.5), (2, 0.9), (3, 0.7)):
        store.save(n.where(F.col("n_nationkey") % step == 0), step, metric)
    return store.load("best")


@query("select conv_id, turn, len(string_split(text, ' '))::int as n, length(string_split(text, ' ')[1])::int as first from conversations where text is not null and turn % 2 = 0")
def pretokenize(spark, sf_dir):
    path = _folder(spark, "tokens")
    c = table(spark, sf_dir, "conversations").where("text is not null")
    K.pretokenise(c, ["conv_id", "turn"], "text", _word_lengths, 1 << 30, path)
    return K.gather(spark, path, c.where("turn % 2 = 0"), ["conv_id", "turn"]).select("conv_id", "turn", "n", F.get("ids", F.lit(0)).alias("first"))


@query("select p_partkey, string_split(p_name, ' ')[-1] as last from part")
def split_last(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(T.words(F.col("p_name")), F.lit(-1)).alias("last"))


@query("select p_partkey, case when p_partkey % 6 < 2 then 3 end::int as n_constraints, case when p_partkey % 6 = 0 then 3 when p_partkey % 6 = 1 then 2 end::int as n_pass, case when p_partkey % 6 < 2 then p_partkey % 6 = 1 end as refused, case when p_partkey % 6 < 2 then p_type end as second from part")
def judge_row(spark, sf_dir):
    second = F.get("verdicts", F.lit(1))["constraint"].alias("second")
    return _judged(spark, sf_dir).select("p_partkey", F.when(F.col("verdicts").isNotNull(), F.size("verdicts")).alias("n_constraints"), "n_pass", F.col("flags")["refused"].alias("refused"), second)


@query()
def profile(spark, sf_dir):
    from ..operators.profile import profile as report

    rows = _delta(spark, sf_dir).withColumnRenamed("d", "delta").withColumn("key", F.col("id")).withColumn("raw", F.lit(True)).withColumn("all_matched", F.col("id") % 3 == 0)
    return report(rows.where("id % 4 <> 0"), ["raw", "all_matched"], min_pairs=30, val=rows.where("id % 4 = 0"), min_rows=20)


@query()
def t2_diagnose(spark, sf_dir):
    from ..operators.profile import diagnose

    rows = _delta(spark, sf_dir)
    w = V.linear_probe(rows, "d")
    head = F.array(*(F.lit(float(x)) for x in w))
    s = rows.withColumn("r_chosen", N.dot(F.col("c"), head)).withColumn("r_rejected", N.dot(F.col("r"), head)).withColumn("even", F.col("id") % 2 == 0)
    return diagnose(s, ["even"], w, "d")


@query("select p_partkey, -length(p_name)::double as slot_logp from part")
def slot_logprobs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("prompt"), F.col("p_name").alias("chosen"), F.lit("").alias("rejected"))
    return seams.score_pairs(p, lambda prompts, responses: [-len(r) for r in responses]).select("p_partkey", F.col("r_chosen").alias("slot_logp"))


@query("select p_partkey, round(-0.5::double * len(string_split(p_name, ' ')), 9) as logp from part")
def logps(spark, sf_dir):
    lp = F.transform(F.split("p_name", " "), lambda w: F.lit(-0.5))
    # the first position predicts nothing: one more is put before the words
    row = F.concat(F.array(F.lit(0.0)), lp)
    return _round(table(spark, sf_dir, "part").select("p_partkey", K.sequence_logprob(row, F.transform(row, lambda x: F.lit(1))).alias("logp")), digits=9)


@query("select p_partkey, p_partkey % 7 <> 0 as answered, case when p_partkey % 7 = 0 then 3 when p_partkey % 5 = 0 then 2 else 1 end::int as attempts, case when p_partkey % 7 <> 0 then p_name end as raw from part")
def judge_call(spark, sf_dir):
    """A server that is busy at times, fails for some texts, and refuses a parameter."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.lit("|"), "p_name").alias("text"))
    return J.call_each(rows, "text", _busy_server).select("p_partkey", F.col("call_error").isNull().alias("answered"), "attempts", "raw")


def _busy_server():
    from ..operators.transport import Caller, Rules

    seen = set()

    def post(payload):
        key, _, name = payload["text"].partition("|")
        if "seed" in payload:
            return 400, "seed is not known here"
        if int(key) % 7 == 0:
            return 503, "down"
        if int(key) % 5 == 0 and key not in seen:
            seen.add(key)
            return 429, "busy"
        return 200, name

    return Caller(post, {"seed": 1, "model": "m"}, Rules(retries=2), sleep=lambda s: None)


@query(f"with {SCORED_SQL} select a.uid, round(a.policy_chosen - b.ref_chosen, 9) as logratio from scored a join scored b on a.uid = b.uid")
def make_reference(spark, sf_dir):
    """The cache if it fits the run, made where it is missing."""
    path = _folder(spark, "reference")
    s = scored(spark, sf_dir)
    header = {"fingerprint": K.fingerprint("m", "sum"), "data_digest": "d", "length_norm": "sum"}
    s.select("uid", F.col("ref_chosen").alias("chosen"), F.col("ref_rejected").alias("rejected")).write.parquet(path)
    L.check_cache(header, K.fingerprint("m", "sum"), "d", "sum")
    found = L.reference_lookup(s.select("uid", "policy_chosen"), spark.read.parquet(path))
    return _round(found.select("uid", (F.col("policy_chosen") - F.col("ref_chosen")).alias("logratio")), digits=9)


@query()
def train_reward(spark, sf_dir):
    """A reward head over frozen vectors, and what it scores."""
    rows = _delta(spark, sf_dir)
    w = V.linear_probe(rows, "d")
    head = F.array(*(F.lit(float(x)) for x in w))
    return _round(M.pair_metrics(rows.select(N.dot(F.col("c"), head).alias("r_chosen"), N.dot(F.col("r"), head).alias("r_rejected"))))


@query(
    """select * from (values ('split.val_frac=0.3', '0.3'), ('split.method=random', 'random'), ('split.method=other', 'refused'), ('split.seed=0x10', '16'), ('split.seed=2.5', 'refused'), ('split.seed=true', 'refused'), ('split.drop_exact_duplicates=yes', 'True'), ('split.drop_exact_duplicates=2', 'refused'),
    ('data.slice_keys=a, b,,c', 'a|b|c'), ('data.json_key=null', 'None'), ('split.vall_frac=1', 'refused'), ('split.val_frac', 'refused'), ('nothing.here=1', 'refused')) t(given, value)"""
)
def config_coerce(spark, sf_dir):
    out = []
    for given in ("split.val_frac=0.3", "split.method=random", "split.method=other", "split.seed=0x10", "split.seed=2.5", "split.seed=true", "split.drop_exact_duplicates=yes", "split.drop_exact_duplicates=2", "data.slice_keys=a, b,,c", "data.json_key=null", "split.vall_frac=1", "split.val_frac", "nothing.here=1"):
        try:
            value = config.flatten(config.override(config.Config(), [given]))[given.partition("=")[0]]
            out.append((given, "|".join(value) if isinstance(value, tuple) else str(value)))
        except ConfigError:
            out.append((given, "refused"))
    return spark.createDataFrame(out, "given string, value string")


@query(
    """select * from (values ('policy.model_name=gpt', null), ('', 'policy.model_name'), ('policy.model_name=gpt policy.model_ckpt=x', 'policy.model_name'), ('policy.model_name=gpt loss.beta=0', 'loss.beta'), ('policy.model_name=gpt loss.sft_wt=-1', 'loss.sft_wt'),
    ('policy.model_name=gpt policy.template={response}{prompt}', 'policy.template'), ('policy.model_name=gpt policy.template={prompt}{response}', 'policy.template'), ('policy.model_name=gpt inference.temperature=0 inference.num_samples_per_prompt=2', 'inference.num_samples_per_prompt'),
    ('policy.model_name=gpt inference.top_p=0', 'inference.top_p'), ('policy.model_name=gpt train.disable_dropout=false', 'train.disable_dropout'), ('policy.model_name=gpt reference.precomputed_logp_path=a reference.precomputed_val_logp_path=./a', 'reference.precomputed_val_logp_path')) t(given, fault)"""
)
def config_validate(spark, sf_dir):
    name = "policy.model_name=gpt"
    cases = [name, "", *(f"{name} {x}" for x in (
        "policy.model_ckpt=x", "loss.beta=0", "loss.sft_wt=-1", "policy.template={response}{prompt}", "policy.template={prompt}{response}", "inference.temperature=0 inference.num_samples_per_prompt=2", "inference.top_p=0", "train.disable_dropout=false",
        "reference.precomputed_logp_path=a reference.precomputed_val_logp_path=./a"))]
    return spark.createDataFrame([(c, "|".join(config.dpo_faults(config.override(config.DPOConfig(), c.split()))) or None) for c in cases], "given string, fault string")


@query("with q as (select p_partkey, chr(39) || p_name || chr(39) as t from part where not contains(p_name, chr(39))) select p_partkey, case when length(t) <= 16 then t else substr(t, 1, 7) || '...' || right(t, 6) end as text from q")
def brief(spark, sf_dir):
    from ..errors import brief as short

    return table(spark, sf_dir, "part").where(~F.contains("p_name", F.lit("'"))).select("p_partkey", F.udf(lambda x: short(x, 16), "string")("p_name").alias("text"))


@query("select vec_id % 3 as part, count(*) filter (where vec_id % 5 <> 0 and vec_id % 2 = 0) as n_decay_tensors, 64 * count(*) filter (where vec_id % 5 <> 0 and vec_id % 2 = 0) as n_decay, 64 * count(*) filter (where vec_id % 5 = 0) as n_frozen, round(coalesce(sum(case when vec_id % 5 <> 0 then len(list_filter(embedding::double[], lambda x: abs(x) > 0.1024)) end) / (64.0 * count(*) filter (where vec_id % 5 <> 0)), 0), 9) as frac_stuck from embeddings group by 1")
def optimizer_groups(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(8), F.lit(8))).otherwise(F.array(F.lit(64))).alias("shape"), (F.col("vec_id") % 5 != 0).alias("trainable"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    parts = [M.optimizer_groups(e.where(F.col("vec_id") % 3 == k), 0.0002).select(F.lit(k).cast("long").alias("part"), "n_decay_tensors", "n_decay", "n_frozen", "frac_stuck") for k in range(3)]
    return _round(parts[0].union(parts[1]).union(parts[2]), digits=9)


@query()
def train_dpo(spark, sf_dir):
    """A DPO head over frozen vectors beside stored log-probabilities: the curve of its fit."""
    from ..operators import dpo_train

    rows = _delta(spark, sf_dir).select("id", F.col("d").alias("delta"), *(F.lit(0.0).alias(c) for c in ("policy_chosen", "policy_rejected", "ref_chosen", "ref_rejected")))
    return dpo_train.report(spark, dpo_train.fit(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), steps=10, every=5))


@query("select p_partkey, length(p_name) * 2.0::double as reward from part")
def udf_score_fn(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.length("p_name") * 2.0).cast("double").alias("reward"))


@query(f"with {PAIRS_SQL} select 'has_the' as name, round(avg(contains(chosen, 'the')::int), 9) as p_chosen, round(avg(contains(rejected, 'the')::int), 9) as p_rejected from pairs")
def udf_probe(spark, sf_dir):
    return _round(A.surface_probes(pairs(spark, sf_dir), {"has_the": lambda t: F.contains(t, F.lit("the"))}).select("name", "p_chosen", "p_rejected"), digits=9)


@query("select doc_id, (length(text) % 7)::double as first from documents")
def udf_embed_backend(spark, sf_dir):
    """An encoder of one's own in the place of the default one."""
    encode = lambda rows: rows.select("sha", F.array((F.length("text") % 7).cast("double")).alias("vector"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    none = spark.createDataFrame([], "sha string, vector array<double>")
    return d.withColumn("sha", F.sha2("text", 256)).join(L.embed_missing(d.select("text"), none, encode), "sha").select("doc_id", F.get("vector", F.lit(0)).alias("first"))
