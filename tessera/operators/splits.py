"""Splits by prompt that share no prompt, exact-duplicate rows, and reports of both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DataError
from ..functions.numbers import hash_unit
from .order import with_index

#: Prompts that assign_random permutes by numbers on the driver (8 bytes each).
PERMUTED = 10_000_000


def row_dedup(rows: DataFrame, order: str) -> DataFrame:
    """rows with copy: 0 for the first of equal rows by `order`, which itself does not count, then 1, 2 and so on.

    Rows are numbered in one order of their hashes; a copy's number is its distance from the first. Only rows that have
    copies are joined, by a table of one row for each, whose join may be split where one record is very frequent.
    """
    columns = sorted(c for c in rows.columns if c != order)
    numbered = with_index(rows.withColumn("_h", F.sha2(F.to_json(F.struct(*columns)), 256)), ["_h", order], "_i")
    first = numbered.groupBy("_h").agg(F.min("_i").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return numbered.join(first, "_h", "left").withColumn("copy", F.coalesce(F.col("_i") - F.col("_first"), F.lit(0)).cast("int")).drop("_h", "_i", "_first")


def assign_hash(rows: DataFrame, val_frac: float, prompt: str = "prompt") -> DataFrame:
    """rows with is_val, from the prompt alone: no join, and the same at every size and partitioning."""
    _check(val_frac)
    return rows.withColumn("is_val", hash_unit(F.coalesce(F.col(prompt), F.lit(""))) < F.lit(float(val_frac)))


def assign_random(rows: DataFrame, val_frac: float, seed: int = 0, prompt: str = "prompt") -> DataFrame:
    """rows with is_val, by one permutation of the sorted prompts, which stay in a table; the driver holds numbers alone.

    Beyond PERMUTED prompts the order is that of a hash of seed and prompt, which needs no numbers on the driver.
    """
    _check(val_frac)
    spark, own = rows.sparkSession, F.coalesce(F.col(prompt), F.lit(""))
    prompts = rows.select(own.alias("_p")).distinct()
    n = prompts.count()
    if n < 2:
        raise DataError("a split needs two prompts")
    m = max(1, min(n - 1, round(val_frac * n)))
    if n <= PERMUTED:
        chosen = pd.DataFrame({"_i": np.random.default_rng(seed).permutation(n)[:m]})
        val = with_index(prompts, ["_p"], "_i").join(spark.createDataFrame(chosen), "_i").select("_p")
    else:
        val = with_index(prompts.withColumn("_h", F.xxhash64(F.lit(seed), "_p")), ["_h", "_p"], "_i").where(F.col("_i") < m).select("_p")
    return rows.withColumn("_p", own).join(val.withColumn("_v", F.lit(True)), "_p", "left").withColumn("is_val", F.coalesce("_v", F.lit(False))).drop("_p", "_v")


def _check(val_frac: float) -> None:
    if not 0 < val_frac < 1:
        raise ConfigError("val_frac must lie between 0 and 1")


def split_records(rows: DataFrame, order: str, val_frac: float = 0.1, method: str = "hash", seed: int = 0, prompt: str = "prompt", drop_exact_duplicates: bool = False) -> DataFrame:
    """rows with copy and is_val, duplicates out if asked for."""
    marked = row_dedup(rows, order)
    if drop_exact_duplicates:
        marked = marked.where("copy = 0")
    if method == "hash":
        return assign_hash(marked, val_frac, prompt)
    if method == "random":
        return assign_random(marked, val_frac, seed, prompt)
    raise ConfigError(f"unknown method {method!r}")


def split_report(split: DataFrame, prompt: str = "prompt") -> DataFrame:
    """One row of what split_records made: rows and prompts of both sides, shares, surplus rows, prompts in both."""
    by_prompt = split.groupBy(F.coalesce(F.col(prompt), F.lit("")).alias("p")).agg(F.count("*").alias("n"), F.count_if("is_val").alias("v"), F.count_if(F.col("copy") > 0).alias("d"))
    val = F.col("v") > 0
    return by_prompt.agg(
        F.sum("n").cast("bigint").alias("n_rows"), F.count("*").alias("n_prompts"), F.sum("d").cast("bigint").alias("n_exact_duplicate_rows"), F.sum(F.col("n") - F.col("v")).cast("bigint").alias("n_rows_train"), F.sum("v").cast("bigint").alias("n_rows_val"),
        F.count_if(F.col("v") < F.col("n")).alias("n_prompts_train"), F.count_if(val).alias("n_prompts_val"), F.count_if(val & (F.col("v") < F.col("n"))).alias("n_overlap_prompts"), F.min("n").alias("rows_per_prompt_min"), F.max("n").alias("rows_per_prompt_max"),
    )


def first_prompts(rows: DataFrame, n: int, order: str, prompt: str = "prompt") -> DataFrame:
    """The first n different prompts by their first row."""
    return rows.groupBy(prompt).agg(F.min(order).alias("first")).orderBy("first", prompt).limit(n)


def unique_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each value of key, by a partial aggregate: a frequent value gives one row a task."""
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_r"))
    return first.select(*(F.col("_r")[c].alias(c) for c in rows.columns))
