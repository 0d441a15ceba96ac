"""Queries of pruned vector joins, tests over all rows, stores that outlive a run, fits by minibatches and spoken rhymes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import ContractError
from ..operators import cells, dpo_train, minimal, mmd, unigram
from ..operators import vectors as V
from ..sources import stores
from .fixtures import PAIRS_SQL, pairs, table
from .metric_queries import _END, _NEAR, _fake, _round
from .more_queries import _D2, _folder
from .registry import query

# --- vectors -------------------------------------------------------------------------------------------------------------------


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query(f"select key, round(best, 6) as best, over from ({_NEAR})")
def pruned_cosine_join(spark, sf_dir):
    """The rows of blocked_cosine_join, by cells that can reach the threshold."""
    e = _embeddings(spark, sf_dir)
    return _round(cells.nearest(e, e, "key", "v", 0.4).drop("compared"))


@query(
    f"""with k as (select a.vec_id % 2 as x, b.vec_id % 2 as y, exp(-0.5 * {_D2}) as k from embeddings a, embeddings b where a.vec_id <> b.vec_id), n as (select count(*) filter (where vec_id % 2 = 0) as m, count(*) filter (where vec_id % 2 = 1) as k from embeddings)
    select round((select sum(k) from k where x = 0 and y = 0) / (n.m * (n.m - 1)) + (select sum(k) from k where x = 1 and y = 1) / (n.k * (n.k - 1)) - 2 * (select sum(k) from k where x = 0 and y = 1) / (n.m * n.k), 9) as mmd2, n.m as n_a, n.k as n_b, 'ok' as status from n"""
)
def mmd_all_rows(spark, sf_dir):
    """The statistic of the permutation test over all rows; its p-value is held against one kernel matrix in the tests."""
    e = _embeddings(spark, sf_dir)
    found = mmd.permutation_test(e.where("key % 2 = 0"), e.where("key % 2 = 1"), "v", "key", gamma=0.5)
    return _round(found.select("mmd2", "n_a", "n_b", "status"), digits=9)


# --- stores ----------------------------------------------------------------------------------------------------------------------

_LETTERS = "etaoinsh"


@query(
    f"""select doc_id, {" || ',' || ".join(f"(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{x}', '')))::varchar" for x in _LETTERS)} as counts,
    case when exists (select 1 from documents e where e.doc_id % 3 = 0 and coalesce(e.text, '') = coalesce(d.text, '')) then 1 else 2 end as run from documents d"""
)
def embed_store(spark, sf_dir):
    """Two runs over one store: the second encodes only texts that the first has not met. run: which of them made a row's vector."""
    path, docs = _folder(spark, "vectors"), table(spark, sf_dir, "documents").select("doc_id", "text")

    def encode(run):
        lower = F.lower("text")
        counts = [(F.length(lower) - F.length(F.replace(lower, F.lit(x), F.lit("")))).cast("double") for x in _LETTERS]
        return lambda missing: missing.select("sha", F.array(*counts, F.lit(float(run))).alias("vector"))

    stores.VectorStore(spark, path, "letters", buckets=8).embed(docs.where("doc_id % 3 = 0"), "text", encode(1)).count()
    found = stores.VectorStore(spark, path, "letters").embed(docs, "text", encode(2))
    counts = F.array_join(F.transform(F.slice("vector", 1, len(_LETTERS)), lambda x: x.cast("bigint").cast("string")), ",")
    return found.select("doc_id", counts.alias("counts"), F.element_at("vector", -1).cast("int").alias("run"))


_TOKENS = "unnest(regexp_extract_all(lower({x}), '[a-z0-9'']+|\\n'))"
_UNIGRAM = f"""
toks as (select {_TOKENS.replace('{x}', 'text')} as token from documents), counts as (select token, count(*) as n from toks group by token), size as (select sum(n) as all_n, count(*) as kinds from counts),
sides as (select pair_uid, 'c' as side, {_TOKENS.replace('{x}', 'chosen')} as token from pairs union all select pair_uid, 'r', {_TOKENS.replace('{x}', 'rejected')} from pairs),
logps as (select pair_uid, side, sum(ln((coalesce(n, 0) + 1) / (all_n + kinds + 1))) as logp from sides left join counts using (token), size group by all),
ref as (select p.pair_uid, round(coalesce(c.logp, 0), 5) as ref_chosen, round(coalesce(r.logp, 0), 5) as ref_rejected
  from pairs p left join (select * from logps where side = 'c') c using (pair_uid) left join (select * from logps where side = 'r') r using (pair_uid))
"""


def _reference(spark, sf_dir):
    model = unigram.fit(table(spark, sf_dir, "documents"), "text")
    return lambda rows: unigram.score_pairs(rows, model)


@query(f"with {PAIRS_SQL}, {_UNIGRAM} select * from ref")
def reference_cache(spark, sf_dir):
    """A cache that a token model over all documents fills, published and read again."""
    found = stores.make_reference(pairs(spark, sf_dir), _folder(spark, "reference"), _reference(spark, sf_dir), "unigram:documents")
    return _round(found.select("pair_uid", "ref_chosen", "ref_rejected"), digits=5)


@query(f"with {PAIRS_SQL} select count(*) as n_pairs, 'kept' as same_run, 'refused' as changed_pair, 'refused' as other_model from pairs")
def reference_refused(spark, sf_dir):
    """What three runs make of one cache: the same run reads it; one with a changed pair, and one of another model, do not."""
    path, rows, score = _folder(spark, "reference"), pairs(spark, sf_dir), _reference(spark, sf_dir)
    n = stores.make_reference(rows, path, score, "a").count()

    def tried(rows, fingerprint):
        try:
            stores.make_reference(rows, path, score, fingerprint)
        except ContractError:
            return "refused"
        return "kept"

    least = rows.agg(F.min("pair_uid")).first()[0]
    changed = rows.withColumn("rejected", F.when(F.col("pair_uid") == least, F.concat("rejected", F.lit("!"))).otherwise(F.col("rejected")))
    return spark.createDataFrame([(n, tried(rows, "a"), tried(changed, "a"), tried(rows, "b"))], "n_pairs long, same_run string, changed_pair string, other_model string")


@query()
def train_dpo_batches(spark, sf_dir):
    """The curve of a fit by minibatches over hashed vectors of whole responses, beside log-probabilities of token models: of all documents
    as the reference, of chosen responses as the policy. tests/test_store_queries.py has its plain definition."""
    rows = dpo_features(spark, sf_dir)
    plan = dpo_train.Plan(epochs=2, batch_size=256, schedule="linear", warmup=2, every=2)
    return dpo_train.report(spark, dpo_train.fit_batches(rows.where("pair_uid % 5 <> 0"), rows.where("pair_uid % 5 = 0"), "pair_uid", plan))


def dpo_features(spark, sf_dir):
    """pair_uid, delta and the four log-probabilities (means over tokens)."""
    rows = pairs(spark, sf_dir).select("pair_uid", "chosen", "rejected")
    models = {"ref": unigram.fit(table(spark, sf_dir, "documents"), "text"), "policy": unigram.fit(rows, "chosen")}
    out = V.hash_embed(V.hash_embed(rows, "chosen", 16, "c"), "rejected", 16, "r")
    share = lambda v: F.transform(v, lambda x: x / F.greatest(F.aggregate(v, F.lit(0.0), lambda a, y: a + y), F.lit(1.0)))
    out = out.select("pair_uid", F.zip_with(share(F.col("c")), share(F.col("r")), lambda a, b: a - b).alias("delta"))
    for name, model in models.items():
        scored = unigram.score_pairs(rows, model, length_norm="mean")
        out = out.join(scored.select("pair_uid", F.col("chosen").alias(f"{name}_chosen"), F.col("rejected").alias(f"{name}_rejected")), "pair_uid")
    return out


# --- spoken rhymes -------------------------------------------------------------------------------------------------------------------

_VOWEL = "[aeiouy]"


def _sentences(spark, sf_dir):
    """doc_id, text: the first two sentences of a document, a line each."""
    s = F.split("text", r"\.")
    line = lambda i: F.trim(F.regexp_replace(F.get(s, F.lit(i)), r"\s+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(line(0), F.lit("\n"), line(1)).alias("text"))


def _spoken(rows):
    """Pronunciations of ASCII words by spelling: a symbol for each letter, the last vowel stressed; a second variant that does not count."""
    return _spoken_of(minimal.couplets(rows, "text"))


def _spoken_of(c):
    words = c.select(F.explode(F.array("w1", "w2")).alias("word")).where(F.col("word").rlike("^[a-z]+$")).distinct()
    last = F.length("word") - F.length(F.regexp_extract("word", f"{_VOWEL}[^aeiouy]*$", 0))
    symbol = lambda x, i: F.concat(F.upper(x), F.when(x.rlike(_VOWEL), F.when(i == last, "1").otherwise("0")).otherwise(""))
    said = F.array_join(F.transform(F.filter(F.split("word", ""), lambda x: x != ""), symbol), " ")
    return words.select("word", F.explode(F.array(F.struct(F.lit(0).alias("variant"), said.alias("phones")), F.struct(F.lit(1).alias("variant"), F.lit("X1").alias("phones")))).alias("p")).select("word", "p.*")


_COUPLETS = rf"""
cut as (select doc_id, [x for x in [trim(regexp_replace(string_split(text, '.')[i], '\s+', ' ', 'g')) for i in [1, 2]] if x <> ''] as lines from documents where text is not null and len(string_split(text, '.')) >= 2),
ends as (select doc_id, lines, {_END('lines[1]')} as w1, {_END('lines[2]')} as w2 from cut),
keyed as (select *, case when regexp_matches(w1, '^[a-z]+$') then coalesce(nullif(regexp_extract(w1, '[aeiouy][^aeiouy]*$'), ''), w1) end as k1, case when regexp_matches(w2, '^[a-z]+$') then coalesce(nullif(regexp_extract(w2, '[aeiouy][^aeiouy]*$'), ''), w2) end as k2 from ends)
"""


@query(f"with {_COUPLETS}, w as (select w1 as word, k1 as key from keyed union select w2, k2 from keyed) select * from w where key is not null")
def spoken_rhyme_key(spark, sf_dir):
    found = minimal.rhymes_of(_spoken(_sentences(spark, sf_dir)))
    return found.select("word", F.lower(F.replace("key", F.lit(" "), F.lit(""))).alias("key"))


@query(f"with {_COUPLETS} select doc_id, coalesce(len(lines) = 2 and w1 <> w2 and k1 = k2, false) as rhymes from keyed union all select doc_id, false from documents where text is null or len(string_split(text, '.')) < 2")
def spoken_couplets(spark, sf_dir):
    rows = _sentences(spark, sf_dir)
    return minimal.couplet_rhymes(minimal.couplets(rows, "text"), minimal.rhymes_of(_spoken(rows))).select("doc_id", "rhymes")


@query(
    f"""with {_COUPLETS}, pool as (select w2 as word, any_value(k2) as key, log2(count(*)::double) as l from keyed where len(lines) = 2 and w2 <> '' group by w2),
    asked as (select distinct w1, k1, w2 from keyed where len(lines) = 2 and w1 <> w2 and k1 = k2),
    near as (select w1, a.w2, w.word as w, abs(w.l - p.l) as d from asked a join pool p on p.word = a.w2 join pool w on abs(w.l - p.l) <= 2 and w.key is not null and w.key <> a.k1 and w.word <> a.w1 and w.word <> a.w2),
    band as (select w1, w2, case when count(*) filter (where d <= 1) >= 2 then 1 else 2 end as band from near group by all),
    offered as (select k.doc_id, k.lines, k.w1, k.w2, n.w, row_number() over (partition by k.doc_id order by length(n.w), n.w) as place from keyed k join band b using (w1, w2) join near n on n.w1 = k.w1 and n.w2 = k.w2 and n.d <= b.band where len(k.lines) = 2),
    short as (select *, (length(w2) - length(w)) / 10 as gap from offered where place <= 8),
    good as (select *, row_number() over (partition by doc_id order by length(w), w) as r, count(*) over (partition by doc_id) as n from short where gap >= -10),
    shared as (select *, list_max([n for n in range(0, least(length(w1), length(w)) + 1) if right(w1, n::int) = right(w, n::int)]) as s from good where n >= 2 and r <= 2)
    select doc_id, case when s >= 3 then '3+' else s::varchar end as near_miss, w as replacement, round(gap, 6) as gap from shared"""
)
def spoken_minimal_pairs(spark, sf_dir):
    """Minimal pairs of couplets that rhyme as they are said; scorers prefer short words."""
    rows = _sentences(spark, sf_dir)
    found, _ = minimal.build_split(rows, "doc_id", "text", lambda c: minimal.rhymes_of(_spoken_of(c)), lambda r: _fake(r, "slot"), lambda r: _fake(r, "score"))
    return found.select("doc_id", "near_miss", "replacement", F.round("gap", 6).alias("gap"))
