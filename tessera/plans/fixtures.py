"""Preference data made from the driver's tables, as DataFrames and as the same tables in SQL.

Groups: labelled documents of one source among 200 neighbouring ids, scored quality - toxic; so a group is small at any
size of the tables. Triples: three embeddings in a row. Scored pairs: numbers of a line item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.formats import load_groups
from ..operators.pairs import to_pairs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", "text", "lang", F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 200).cast("string")).alias("prompt"), (F.col("quality") - F.col("toxic")).cast("double").alias("score"))


def kway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt, responses, scores, family: one row for each group, singles too."""
    rows = labelled(spark, sf_dir).groupBy("prompt").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text", "score"))).alias("_all"))
    return rows.select("prompt", F.transform("_all", lambda x: x["text"]).alias("responses"), F.transform("_all", lambda x: x["score"]).alias("scores"), F.split("prompt", "/")[0].alias("family"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_groups(kway(spark, sf_dir), "kway", slice_keys=["family"], max_drop_rate=1.0)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_pairs(groups(spark, sf_dir))


#: labelled, members (one row a response), pairs
PAIRS_SQL = """
labelled as (
  select d.doc_id, d.text, d.lang, d.source || '/' || cast(floor(d.doc_id / 200) as bigint) as prompt, cast(l.quality - l.toxic as double) as score
  from documents d join labels l on d.doc_id = l.doc_id
), sized as (
  select *, count(*) over (partition by prompt) as k, row_number() over (partition by prompt order by doc_id) - 1 as idx from labelled
), members as (
  select *, dense_rank() over (order by prompt) - 1 as uid, rank() over (partition by prompt order by score desc) - 1 as rnk, dense_rank() over (partition by prompt order by score desc) as lvl,
    string_split(prompt, '/')[1] as family
  from sized where k >= 2
), pairs as (
  select a.uid * 1000000 + a.idx * 1000 + b.idx as pair_uid, a.uid as group_uid, a.idx as chosen_idx, b.idx as rejected_idx, a.prompt, a.family, a.text as chosen, b.text as rejected, a.score - b.score as margin_hint, a.lvl as clvl, b.lvl as rlvl
  from members a join members b on a.prompt = b.prompt and a.rnk < b.rnk
)
"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, prompt, p, c, r: embeddings 3 id, 3 id + 1 and 3 id + 2. Every third prompt is shared by two rows."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("id"), F.pmod("vec_id", F.lit(3)).alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    wide = e.groupBy("id").agg(*(F.max(F.when(F.col("k") == i, F.col("v"))).alias(c) for i, c in enumerate("pcr")))
    whole = wide.where(F.col("p").isNotNull() & F.col("c").isNotNull() & F.col("r").isNotNull())
    return whole.select("id", F.concat(F.lit("prompt "), F.floor(F.col("id") / 2).cast("string")).alias("prompt"), "p", "c", "r")


TRIPLES_SQL = """
triples as (
  select a.vec_id // 3 as id, 'prompt ' || cast(a.vec_id // 3 // 2 as varchar) as prompt, a.embedding::double[] as p, b.embedding::double[] as c, c.embedding::double[] as r
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 join embeddings c on c.vec_id = a.vec_id + 2 where a.vec_id % 3 = 0
)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, r_chosen, r_rejected, policy_* and ref_* log-probabilities, slices flag and status."""
    x = table(spark, sf_dir, "lineitem")
    uid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return x.select(
        uid.alias("uid"), (F.col("l_extendedprice") / 10000).alias("r_chosen"), (F.floor("l_quantity") / 10).alias("r_rejected"), (-F.col("l_quantity") / 5).alias("policy_chosen"), (-F.col("l_extendedprice") / 10000).alias("policy_rejected"),
        (F.lit(0.0) - F.col("l_tax") * 100).alias("ref_chosen"), (F.lit(0.0) - F.col("l_discount") * 100).alias("ref_rejected"), F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus").alias("slices"),
    )


SCORED_SQL = """
scored as (
  select l_orderkey * 10 + l_linenumber as uid, l_extendedprice / 10000 as r_chosen, floor(l_quantity) / 10 as r_rejected, -l_quantity / 5 as policy_chosen, -l_extendedprice / 10000 as policy_rejected,
    0 - l_tax * 100 as ref_chosen, 0 - l_discount * 100 as ref_rejected, l_returnflag as flag, l_linestatus as status
  from lineitem
)
"""
