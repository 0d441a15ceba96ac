"""Chats of two turns as pairs, and the histograms of a set of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, words
from .order import banker_rule, quantiles


def chat_to_pair(rows: DataFrame, max_words: int | None = None) -> DataFrame:
    """rows (id, prompt, chosen, rejected as arrays of role and content, constraints) as pairs, with the reason for dropping one.

    Both sides must be the user's prompt and an assistant's answer; equal answers, and ones over max_words, are dropped.
    """
    sound = None
    for side in ("chosen", "rejected"):
        m = F.col(side)
        ok = (F.size(m) == 2) & (F.get(m, F.lit(0))["role"] == "user") & (F.get(m, F.lit(1))["role"] == "assistant") & (F.get(m, F.lit(0))["content"] == F.col("prompt"))
        sound = ok if sound is None else sound & ok
    a, b = F.get("chosen", F.lit(1))["content"], F.get("rejected", F.lit(1))["content"]
    long = F.greatest(F.size(words(a)), F.size(words(b))) > (max_words if max_words else 1 << 30)
    reason = F.when(~F.coalesce(sound, F.lit(False)), "not a user's prompt and an answer").when(strip(a) == strip(b), "identical").when(long, "over length")
    c = F.transform("constraints", strip)
    return rows.select("id", "prompt", a.alias("chosen"), b.alias("rejected"), F.size(c).alias("n_constraints"), strip(F.split(F.get(c, F.lit(0)), ":", 2)[0]).alias("constraint_family"), F.array_join(c, " | ").alias("constraints"), reason.alias("reason"))


def histograms(pairs: DataFrame) -> DataFrame:
    """kind, value, n: families and numbers of constraints."""
    each = F.array(F.struct(F.lit("family").alias("kind"), F.col("constraint_family").alias("value")), F.struct(F.lit("n_constraints").alias("kind"), F.col("n_constraints").cast("string").alias("value")))
    return pairs.select(F.explode(each).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def word_percentiles(pairs: DataFrame) -> DataFrame:
    """field, p50, p90, p99, max of the number of words, positions rounded to even."""
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.size(words(F.col(c))).alias("n")) for c in ("prompt", "chosen", "rejected")))
    rows = pairs.select(F.explode(each).alias("x")).select("x.field", "x.n")
    return quantiles(rows, "n", {"p50": banker_rule(0.5), "p90": banker_rule(0.9), "p99": banker_rule(0.99), "most": banker_rule(1.0)}, ["field"])
