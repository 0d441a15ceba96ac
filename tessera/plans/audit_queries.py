"""Queries of loading, pairs and Tier 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import hash_unit
from ..functions.text import BASELINES, PROBES, tokens
from ..operators import audit as A
from ..operators import formats, pairs as P
from ..session import checkpointed
from .fixtures import PAIRS_SQL, groups, kway, labelled, pairs, table
from .registry import query

# --- text features in SQL --------------------------------------------------------------------------------------------------

_W = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"
_LW = "list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> '')"
_UWR = f"coalesce(len(list_distinct({_LW}))::double / nullif(len({_LW}), 0), 0)"
BASELINE_SQL = {
    "char_length": "length({t})::double",
    "word_count": f"len({_W})::double",
    "newline_count": "(length({t}) - length(replace({t}, chr(10), '')))::double",
    "punctuation": "(length({t}) - length(translate({t}, '.,;:!?\"''()[]{{}}-—', '')))::double",
    "unique_word_ratio": _UWR,
    "avg_word_length": f"coalesce(list_sum(list_transform({_W}, lambda w: length(w)))::double / nullif(len({_W}), 0), 0)",
}
PROBE_SQL = {
    "has_newline": "contains({t}, chr(10))",
    "multi_line": "contains({t}, chr(10))",
    "markdown_bold": "contains({t}, '**')",
    "markdown_header": "regexp_matches({t}, '(?m)^#{{1,6}} ')",
    "bullet_list": "regexp_matches({t}, '(?m)^\\s*[-*+] ')",
    "numbered_list": "regexp_matches({t}, '(?m)^\\s*\\d+[.)] ')",
    "code_fence": "contains({t}, '```')",
    "emoji": "regexp_matches({t}, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]')",
    "question_mark": "contains({t}, '?')",
    "exclamation": "contains({t}, '!')",
    "hedging": "regexp_matches({t}, '(?i)\\b(i think|it''?s important to note|generally|typically|in general|keep in mind|as always)\\b')",
    "refusal": "regexp_matches({t}, '(?i)\\b(i cannot|i can''?t|as an ai|i''?m unable|i apolog)')",
    "ends_with_period": "ends_with(regexp_replace({t}, '\\s+$', ''), '.')",
    "has_comma": "contains({t}, ',')",
    "repetitive": f"{_UWR} < 0.5",
}
_HASH = "(('0x' || substr(sha256({t}), 1, 8))::bigint / 4294967296.0)"


def _sql(form: str, t: str) -> str:
    return form.replace("{{", "\0").replace("}}", "\1").replace("{t}", t).replace("\0", "{").replace("\1", "}")


@query("select doc_id, " + ", ".join(f"round({_sql(f, 'text')}, 9) as {k}" for k, f in BASELINE_SQL.items()) + " from documents")
def text_baselines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(F.round(f(F.col("text")), 9).alias(k) for k, f in BASELINES.items()))


@query("select doc_id, " + ", ".join(f"{_sql(f, 'text')} as {k}" for k, f in PROBE_SQL.items()) + " from documents")
def text_probes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(f(F.col("text")).alias(k) for k, f in PROBES.items()))


@query("select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9'']+|\\n'))::bigint as n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+|\\n')))::bigint as n_types from documents")
def tokenize(spark, sf_dir):
    t = tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_types"))


# --- loading ---------------------------------------------------------------------------------------------------------------

_CONV = "select *, lead(role) over (partition by conv_id order by turn) as nr, lead(text) over (partition by conv_id order by turn) as nt from conversations"


def _turns(spark, sf_dir):
    """User turns with the turn that follows; a conversation is read by its own window only."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("nr", F.lead("role").over(w)).withColumn("nt", F.lead("text").over(w)).where("role = 'user'")


@query(f"with t as ({_CONV}) select coalesce(text, '') as prompt, nt as chosen, 'refused' as rejected, case when nt is null then 'a side is null' end as reason from t where role = 'user'")
def fmt_pairwise(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.col("text").alias("q"), F.col("nt").alias("good"), F.lit("refused").alias("bad"))
    g = formats.to_groups(rows, "pairwise", formats.FieldMap.of({"prompt": "q", "chosen": "good", "rejected": "bad"}))
    return g.select("prompt", F.col("good").alias("chosen"), F.get("responses", F.lit(1)).alias("rejected"), "reason")


@query(f"with t as ({_CONV}) select '' as prompt, nt as chosen, coalesce(text, '') as rejected, 2 as k from t where role = 'user' and nt is not null and text is not null")
def fmt_pairwise_implicit(spark, sf_dir):
    rows = _turns(spark, sf_dir).select(F.col("nt").alias("chosen"), F.col("text").alias("rejected"))
    g = formats.to_groups(rows, "pairwise_implicit").where("reason is null")
    return g.select("prompt", F.get("responses", F.lit(0)).alias("chosen"), F.get("responses", F.lit(1)).alias("rejected"), F.size("responses").alias("k"))


_ARENA = """
with a as (select event_id, event_type as response_a, lead(event_type) over (partition by user_id order by ts, event_id) as response_b, cast(json_extract_string(props, '$.k') as int) as k from events),
w as (select *, case k % 5 when 0 then 'A' when 1 then ' model_b ' when 2 then 'tie' when 3 then '0' else 'zzz' end as winner from a)
"""


@query(
    _ARENA
    + """select event_id, case when k % 5 = 1 then response_b else response_a end as first, case when k % 5 = 1 then response_a else response_b end as second,
      case when response_b is null then 'a response is null' when k % 5 = 2 then 'tie' when k % 5 = 4 then 'the winner is none of the names known' end as reason from w"""
)
def fmt_arena(spark, sf_dir):
    rows = _arena(spark, sf_dir)
    g = formats.to_groups(rows, "arena")
    second = F.when(F.lower(F.trim("winner")) == "model_b", F.col("response_a")).otherwise(F.col("response_b"))
    first = F.when(F.lower(F.trim("winner")) == "model_b", F.col("response_b")).otherwise(F.col("response_a"))
    return g.select("event_id", first.alias("first"), second.alias("second"), "reason")


def _arena(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("").alias("prompt"), F.col("event_type").alias("response_a"), F.lead("event_type").over(w).alias("response_b"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    m = F.col("k") % 5
    return rows.withColumn("winner", F.when(m == 0, "A").when(m == 1, " model_b ").when(m == 2, "tie").when(m == 3, "0").otherwise("zzz"))


@query(_ARENA + ", r as (select case when response_b is null then 'a response is null' when k % 5 = 2 then 'tie' when k % 5 = 4 then 'the winner is none of the names known' end as reason from w) select reason, count(*) as n_rows, round(count(*) / sum(count(*)) over (), 9) as share from r group by reason")
def load_report(spark, sf_dir):
    return formats.load_report(formats.to_groups(_arena(spark, sf_dir), "arena")).withColumn("share", F.round("share", 9))


@query(f"with {PAIRS_SQL} select uid, prompt, max(k) as k, map(['family'], [any_value(family)])['family'] as family, sum(score) as score_sum from members group by uid, prompt")
def load_groups(spark, sf_dir):
    g = groups(spark, sf_dir)
    return g.select("uid", "prompt", F.size("responses").cast("bigint").alias("k"), F.col("slices")["family"].alias("family"), F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("score_sum"))


@query(f"with {PAIRS_SQL} select prompt, case when max(k) < 2 then 'one response or none' end as reason from sized group by prompt")
def group_validate(spark, sf_dir):
    return formats.to_groups(kway(spark, sf_dir), "kway").select("prompt", "reason")


@query(f"with {PAIRS_SQL} select uid, idx, rnk::int as rnk, k, (min(idx) filter (where rnk = 0) over (partition by uid))::int as best_index, max(rnk) over (partition by uid) > 0 as has_signal from members")
def ranks_from_scores(spark, sf_dir):
    g = P.group_flags(groups(spark, sf_dir))
    return g.select("uid", F.posexplode("ranks").alias("idx", "rnk"), F.col("k").cast("bigint").alias("k"), "best_index", "has_signal").withColumn("idx", F.col("idx").cast("bigint"))


# --- pairs -----------------------------------------------------------------------------------------------------------------

_PAIR_COLUMNS = "pair_uid, group_uid, chosen_idx::int as chosen_idx, rejected_idx::int as rejected_idx, margin_hint, sha256(chosen) as chosen, sha256(rejected) as rejected"


def _pairs(spark, sf_dir, policy, **kw):
    p = P.to_pairs(groups(spark, sf_dir), policy, **kw)
    return p.select("pair_uid", "group_uid", "chosen_idx", "rejected_idx", "margin_hint", F.sha2("chosen", 256).alias("chosen"), F.sha2("rejected", 256).alias("rejected"))


@query(f"with {PAIRS_SQL} select {_PAIR_COLUMNS} from pairs")
def pairs_all(spark, sf_dir):
    return _pairs(spark, sf_dir, "all_pairs")


@query(f"with {PAIRS_SQL} select {_PAIR_COLUMNS} from pairs where clvl = 1")
def pairs_best_vs_rest(spark, sf_dir):
    return _pairs(spark, sf_dir, "best_vs_rest")


@query(f"with {PAIRS_SQL} select {_PAIR_COLUMNS} from pairs where rlvl = clvl + 1")
def pairs_adjacent(spark, sf_dir):
    return _pairs(spark, sf_dir, "adjacent")


@query()
def pairs_sampled(spark, sf_dir):
    return _pairs(spark, sf_dir, "all_pairs", max_pairs=2, seed=7)


@query(f"with {PAIRS_SQL} select m.uid, count(p.pair_uid)::bigint as all_pairs, count(p.pair_uid) filter (where p.clvl = 1)::bigint as best_vs_rest, count(p.pair_uid) filter (where p.rlvl = p.clvl + 1)::bigint as adjacent from (select distinct uid from members) m left join pairs p on m.uid = p.group_uid group by m.uid")
def count_pairs(spark, sf_dir):
    return P.count_pairs(groups(spark, sf_dir))


# --- tier 0 ----------------------------------------------------------------------------------------------------------------


@query(
    f"""with {PAIRS_SQL}, g as (select uid, any_value(prompt) as prompt, list(text order by idx) as texts, min(score) = max(score) as tied, bool_or(trim(text) = '') as blank from members group by uid)
    select count(*) as n_groups, count(distinct prompt) as n_unique_prompts, (count(*) - count(distinct (prompt, texts)))::bigint as n_exact_duplicates, count(*) filter (where len(list_distinct(texts)) < len(texts)) as n_identical_sides,
      count(*) filter (where tied) as n_all_tied, count(*) filter (where blank) as n_empty_response from g"""
)
def structure_stats(spark, sf_dir):
    return A.structure_stats(groups(spark, sf_dir))


@query(f"with {PAIRS_SQL} select k::int as k, count(distinct uid) as n_groups from members group by k")
def k_histogram(spark, sf_dir):
    return A.k_histogram(groups(spark, sf_dir))


@query(f"with {PAIRS_SQL} select 'family' as key, count(distinct family) as n_values from members")
def slice_cardinality(spark, sf_dir):
    return A.slice_cardinality(groups(spark, sf_dir))


@query(f"with t as (select distinct text from documents where doc_id % 3 <> 0), v as (select distinct text from documents where doc_id % 3 = 0) select count(*) as n_prompts_val, count(t.text) as n_shared, round(count(t.text) / count(*), 9) as rate from v left join t using (text)")
def leakage_semi(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return A.prompt_leakage(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0")).withColumn("rate", F.round("rate", 9))


_Q = lambda c, q: f"list_sort(list(length({c})))[least(floor({q}::double * count(*))::int, count(*)::int - 1) + 1]::double"


@query(f"with {PAIRS_SQL} " + " union all ".join(f"select '{s}' as side, {_Q(s, 0.05)} as q05, {_Q(s, 0.5)} as q50, {_Q(s, 0.95)} as q95 from pairs" for s in ("chosen", "rejected")))
def length_quantiles(spark, sf_dir):
    return A.length_quantiles(pairs(spark, sf_dir))


@query(f"with {PAIRS_SQL} select round(avg((length(chosen) > length(rejected))::int), 9) as p_longer_wins, round(avg((abs(length(chosen) - length(rejected)) / greatest(length(chosen), length(rejected), 1) < 0.1::double)::int), 9) as frac_near_equal from pairs")
def length_stats(spark, sf_dir):
    s = A.length_stats(pairs(spark, sf_dir))
    return s.select(*(F.round(c, 9).alias(c) for c in s.columns))


_HALF = lambda f: f"avg(case when {_sql(f, 'chosen')} > {_sql(f, 'rejected')} then 1 when {_sql(f, 'chosen')} = {_sql(f, 'rejected')} then 0.5 else 0 end)"
_BASE = " union all ".join(f"select {i} as ord, '{k}' as name, {_HALF(f)} as accuracy from pairs" for i, (k, f) in enumerate(BASELINE_SQL.items()))


@query(f"with {PAIRS_SQL} select name, round(accuracy, 9) as accuracy from ({_BASE})")
def baseline_accuracies(spark, sf_dir):
    return A.baseline_accuracies(pairs(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"with {PAIRS_SQL} select name, round(greatest(accuracy, 1 - accuracy), 9) as score, case when accuracy < 0.5 then 'flipped' else 'direct' end as direction from ({_BASE}) order by round(abs(accuracy - 0.5), 12) desc, ord limit 1")
def best_baseline(spark, sf_dir):
    return A.best_baseline(A.baseline_accuracies(pairs(spark, sf_dir))).withColumn("score", F.round("score", 9))


_PROBE = " union all ".join(f"select '{k}' as name, count_if({_sql(f, 'chosen')})::double as a, count_if({_sql(f, 'rejected')})::double as c, count(*)::double as n from pairs" for k, f in PROBE_SQL.items())


@query(
    f"""with {PAIRS_SQL} select name, round(a / n, 9) as p_chosen, round(c / n, 9) as p_rejected, round(a / n - c / n, 9) as gap,
      round(case when n * n * (a + c) * (2 * n - a - c) = 0 then 0 else 2 * n * (a * (n - c) - (n - a) * c) * (a * (n - c) - (n - a) * c) / (n * n * (a + c) * (2 * n - a - c)) end, 6) as chi2 from ({_PROBE})"""
)
def surface_probes(spark, sf_dir):
    s = A.surface_probes(pairs(spark, sf_dir))
    return s.select("name", *(F.round(c, 9).alias(c) for c in ("p_chosen", "p_rejected", "gap")), F.round("chi2", 6).alias("chi2"))


_LEX = f"""with {PAIRS_SQL}, split as (select *, {_HASH.replace("{t}", "('lexical ' || pair_uid)")} < 0.2::double as is_test from pairs),
toks as (select is_test, pair_uid, true as is_chosen, unnest(regexp_extract_all(lower(chosen), '[a-z0-9'']+|\\n')) as token from split union all select is_test, pair_uid, false, unnest(regexp_extract_all(lower(rejected), '[a-z0-9'']+|\\n')) from split),
cnt as (select token, count(*) filter (where is_chosen) as nc, count(*) filter (where not is_chosen) as nr from toks where not is_test group by token having count(*) >= 2),
tot as (select sum(nc) as tc, sum(nr) as tr, count(*) as v from cnt),
odds as (select token, nc, nr, ln((nc + 1.0) / (tc + v)) - ln((nr + 1.0) / (tr + v)) as lo from cnt, tot)
"""


@query(
    _LEX
    + """, sums as (select pair_uid, sum(case when is_chosen then lo else 0 end) as c, sum(case when not is_chosen then lo else 0 end) as r from toks join odds using (token) where is_test group by pair_uid)
    select round(avg(case when round(coalesce(c, 0), 9) > round(coalesce(r, 0), 9) then 1 when round(coalesce(c, 0), 9) = round(coalesce(r, 0), 9) then 0.5 else 0 end), 9) as accuracy, count(*) as n_test_pairs,
      (select count(*) from split where not is_test) as n_train_pairs, (select v from tot) as vocab_size from split left join sums using (pair_uid) where is_test"""
)
def lexical_probe(spark, sf_dir):
    return A.lexical_probe(checkpointed(pairs(spark, sf_dir))).withColumn("accuracy", F.round("accuracy", 9))


@query(_LEX + "select token, nc as n_chosen, nr as n_rejected, round(lo, 9) as log_odds from odds")
def nb_log_odds(spark, sf_dir):
    return A.token_log_odds(A.split_pairs(pairs(spark, sf_dir)).where("not is_test")).withColumn("log_odds", F.round("log_odds", 9))


@query(_LEX + "(select 'chosen' as side, token, round(lo, 2) as log_odds from odds order by round(lo, 9) desc, token limit 20) union all (select 'rejected', token, round(lo, 2) from odds order by round(lo, 9), token limit 20)")
def top_tokens(spark, sf_dir):
    return A.top_tokens(A.token_log_odds(A.split_pairs(pairs(spark, sf_dir)).where("not is_test")))


@query()
def audit_warnings(spark, sf_dir):
    return A.audit_warnings(A.audit(groups(spark, sf_dir), pairs(spark, sf_dir)))


@query()
def audit(spark, sf_dir):
    g = checkpointed(groups(spark, sf_dir))  # the pairs are those of these groups
    return A.audit(g, checkpointed(P.to_pairs(g)))


@query(f"select doc_id, round({_HASH.replace('{t}', 'text')}, 12) as u, {_HASH.replace('{t}', 'text')} < 0.2::double as is_val from documents")
def hash_unit_split(spark, sf_dir):
    u = hash_unit(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(u, 12).alias("u"), (u < 0.2).alias("is_val"))
