"""Token sequences as arrays: budgets, padding, log-probabilities, digests, schedules, batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from .order import with_index


def encode_pair(prompt: Column, response: Column, max_length: int) -> dict[str, Column]:
    """Ids of a prompt and its response within max_length: the prompt's end is kept, or, if the response alone is too long, its beginning."""
    m = F.lit(max_length)
    room = m - F.size(response)
    cut = F.when(room <= 0, F.slice(prompt, 1, 0)).when(F.size(prompt) > room, F.slice(prompt, -F.greatest(room, F.lit(1)), F.greatest(room, F.lit(1)))).otherwise(prompt)
    return {"prompt_ids": cut, "response_ids": F.slice(response, F.lit(1), F.least(m, F.size(response))), "prompt_truncated": (room >= 0) & (F.size(prompt) > room), "response_truncated": room < 0}


def tokenise(rows: DataFrame, columns: list[str], encode: Callable[[list[str]], list[list[int]]], max_length: int) -> DataFrame:
    """rows with `<column>_ids`, at most max_length of them, and `<column>_truncated`: encode sees the whole texts of a batch."""
    new = [x for c in columns for x in (T.StructField(f"{c}_ids", T.ArrayType(T.IntegerType())), T.StructField(f"{c}_truncated", T.BooleanType()))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in columns:
                ids = encode(batch[c].fillna("").tolist()) if len(batch) else []
                batch[f"{c}_ids"] = pd.Series([x[:max_length] for x in ids], index=batch.index, dtype=object)
                batch[f"{c}_truncated"] = pd.Series([len(x) > max_length for x in ids], index=batch.index, dtype=bool)
            yield batch

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *new]))


def pad_join(rows: DataFrame, first: str, second: str, pad_id: int = 0) -> DataFrame:
    """rows with both lists filled on the right to the length of the longer one."""
    longest = F.greatest(F.size(first), F.size(second))
    fill = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(pad_id), longest - F.size(c)))
    return rows.withColumns({first: fill(first), second: fill(second)})


def pretokenise(rows: DataFrame, key: list[str], text: str, encode: Callable[[list[str]], list[list[int]]], max_length: int, path: str) -> None:
    """Stores the ids of every row once, in lists of any length (no padding)."""
    tokenise(rows.select(*key, text), [text], encode, max_length).select(*key, F.col(f"{text}_ids").alias("ids")).write.parquet(path)


def gather(spark: SparkSession, path: str, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The stored ids of the rows wanted, with their number."""
    return spark.read.parquet(path).join(wanted.select(*key), key).select(*key, "ids", F.size("ids").alias("n"))


def collate(rows: DataFrame, batch: str, pad_id: int = 0) -> DataFrame:
    """rows (prompt_ids, response_ids, batch) with input_ids, attention_mask and completion_mask, padded on the right to the batch's longest."""
    rows = rows.withColumn("_n", F.size("prompt_ids") + F.size("response_ids"))
    longest = rows.groupBy(batch).agg(F.max("_n").alias("_max"), F.min(F.size("response_ids")).alias("_least"))
    rows = rows.join(longest, batch)
    ok = F.when(F.col("_least") == 0, F.raise_error("a row of the batch has no completion").cast("int")).otherwise(0)
    fill = lambda n, v: F.array_repeat(F.lit(v), n)
    pad = F.col("_max") - F.col("_n") + ok
    return rows.select(
        *(c for c in rows.columns if not c.startswith("_")), F.concat("prompt_ids", "response_ids", fill(pad, pad_id)).alias("input_ids"), F.concat(fill(F.col("_n"), 1), fill(pad, 0)).alias("attention_mask"),
        F.concat(fill(F.size("prompt_ids"), 0), fill(F.size("response_ids"), 1), fill(pad, 0)).alias("completion_mask"),
    )


def collate_report(rows: DataFrame) -> DataFrame:
    """Counters over prompt_truncated, response_truncated and lengths; and whether over 5 % are cut."""
    n = F.size("prompt_ids") + F.size("response_ids")
    out = rows.agg(F.count("*").alias("n_rows"), F.count_if("prompt_truncated").alias("n_prompt_truncated"), F.count_if("response_truncated").alias("n_response_truncated"), F.max(n).alias("max_len_seen"), F.min(F.size("response_ids")).alias("min_completion_len"))
    return out.withColumn("warn", F.coalesce(F.try_divide("n_response_truncated", "n_rows") > 0.05, F.lit(False)))


def sequence_logprob(token_logps: Column, mask: Column, length_norm: str = "sum") -> Column:
    """The sum of the log-probabilities where mask is 1, or their mean. The first position predicts nothing and is left out."""
    if length_norm not in ("sum", "mean"):
        raise ConfigError("length_norm is sum or mean")
    tail = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    total = F.aggregate(F.zip_with(tail(token_logps), tail(mask), lambda x, m: F.when(m == 1, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return total if length_norm == "sum" else total / F.greatest(F.aggregate(tail(mask), F.lit(0), lambda a, x: a + x.cast("int")), F.lit(1))


def log_softmax_at(logits: Column, label: Column) -> Column:
    """logits[label] less the logarithm of the sum of exponentials, shifted by the largest."""
    top = F.array_max(logits)
    return F.get(logits, label) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def count_new_tokens(ids: Column, stops: list[int], pad: int) -> tuple[Column, Column]:
    """How many tokens stand before the first stop or pad, and whether that was a stop."""
    halt = [*stops, pad]
    places = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(halt), i)), lambda i: i.isNotNull())
    n = F.coalesce(F.array_min(places), F.size(ids))
    return n, F.coalesce(F.get(ids, n).isin(stops), F.lit(False))


def dataset_digest(pairs: DataFrame, order: str = "pair_uid") -> DataFrame:
    """One row: a digest of pair_uid, prompt, chosen and rejected in order.

    Rows are hashed each, hashes in runs of 4096 by their position, and the runs' hashes in order: no cell holds the data.
    """
    row = F.sha2(F.concat(F.col("pair_uid").cast("string"), F.char(F.lit(0)), "prompt", F.char(F.lit(0)), "chosen", F.char(F.lit(0)), "rejected", F.char(F.lit(1))), 256)
    level = with_index(pairs.select(order, row.alias("h")), [order, "h"], "i").select("i", "h")
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), ""), 256).alias("h")
    for _ in range(3):  # 4096**3 rows and more than that are folded to a short list
        level = level.groupBy(F.floor(F.col("i") / 4096).alias("i")).agg(joined())
    return level.agg(joined()).select(F.substring("h", 1, 16).alias("digest"))


def fingerprint(*parts: str) -> str:
    """16 hexadecimal digits of the parts, joined by NUL."""
    import hashlib

    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def schedule_factor(step: Column, kind: str, warmup: int, total: int) -> Column:
    """The learning rate's factor at a step."""
    if kind not in ("constant", "linear", "cosine"):
        raise ConfigError(f"unknown schedule {kind!r}")
    progress = F.least(F.greatest(step - warmup, F.lit(0)) / F.lit(float(max(total - warmup, 1))), F.lit(1.0))
    after = {"constant": F.lit(1.0), "linear": 1 - progress, "cosine": 0.5 * (1 + F.cos(F.lit(math.pi) * progress))}[kind]
    return F.when(step < warmup, (step + 1) / F.lit(float(max(warmup, 1)))).otherwise(after)


def steps_plan(n: Column, batch_size: int, accumulate: int, epochs: int) -> Column:
    return (F.ceil(F.ceil(n / batch_size) / accumulate) * epochs).cast("bigint")


def epoch_batches(rows: DataFrame, key: str, seed: int, epoch: int, batch_size: int) -> DataFrame:
    """rows with position (a permutation by a hash of seed, epoch and key) and batch."""
    ranked = with_index(rows.withColumn("_h", F.xxhash64(F.lit(seed + epoch), key)), ["_h", key], "position").drop("_h")
    return ranked.withColumn("batch", F.floor(F.col("position") / batch_size))
