"""A language model of single tokens as DataFrame operations: a real, small reference for log-probabilities of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def fit(rows: DataFrame, text: str) -> DataFrame:
    """token, logp: natural logarithms of shares with one added to every count; the row with a null token is that of all others."""
    counts = rows.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count("*").alias("kinds"))
    share = lambda n: F.log((n + 1.0) / (F.col("all") + F.col("kinds") + 1.0))
    known = counts.crossJoin(F.broadcast(total)).select("token", share(F.col("n")).alias("logp"))  # one row
    return known.union(total.select(F.lit(None).cast("string"), share(F.lit(0))))


def logprob(rows: DataFrame, key: str, text: str, model: DataFrame, length_norm: str = "sum") -> DataFrame:
    """key, logp, n_tokens: the sum (or mean) over a text's tokens; 0 for a text without tokens. Tokens meet their counts in a join by token."""
    counted = rows.select(key, F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    other = F.broadcast(model.where("token is null").select(F.col("logp").alias("_other")))  # one row
    found = counted.join(model.where("token is not null"), "token", "left").crossJoin(other)
    sums = found.groupBy(key).agg(F.sum(F.col("n") * F.coalesce("logp", "_other")).alias("logp"), F.sum("n").alias("n_tokens"))
    total = F.coalesce("logp", F.lit(0.0))
    each = total / F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(1)) if length_norm == "mean" else total
    return rows.select(key).join(sums, key, "left").select(key, each.alias("logp"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def score_pairs(pairs: DataFrame, model: DataFrame, key: str = "pair_uid", length_norm: str = "sum") -> DataFrame:
    """key, chosen, rejected: log-probabilities of both responses, in one pass over them."""
    sides = pairs.select(F.explode(F.array(*(F.struct(F.struct(F.col(key).alias("key"), F.lit(s).alias("side")).alias("of"), F.col(s).alias("text")) for s in ("chosen", "rejected")))).alias("x")).select("x.*")
    scored = logprob(sides, "of", "text", model, length_norm)
    return scored.groupBy(F.col("of.key").alias(key)).agg(*(F.max(F.when(F.col("of.side") == s, F.col("logp"))).alias(s) for s in ("chosen", "rejected")))
