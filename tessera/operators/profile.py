"""Tier 1 and Tier 2 as reports of one row: every block with its status, null where it could not run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from . import metrics as M
from . import vectors as V


def _one_row(spark: SparkSession, blocks: list[DataFrame]) -> DataFrame:
    """The single rows of all blocks side by side, each computed once; of equal names the first counts."""
    fields: dict[str, T.StructField] = {}
    values: dict[str, object] = {}
    for block in blocks:
        row = block.first()
        for f in block.schema.fields:
            if f.name not in fields:
                fields[f.name], values[f.name] = T.StructField(f.name, f.dataType), row[f.name]
    return spark.createDataFrame([tuple(values.values())], T.StructType(list(fields.values()))).coalesce(1)


#: What a report lacks where a block could not run, for the warnings.
_WARNED = ("frac_surface_controlled", "separability_min", "top_confound_drop", "mean_pairwise_cosine", "frac_rejected_offtopic", "n_cross", "effective_sample_ratio")


def profile(
    rows: DataFrame, masks: list[str], min_pairs: int = 100, min_confident: int = 500, isolated: float = 0.5, offtopic: float = 0.2, val: DataFrame | None = None, near_dup_tau: float = 0.95, permutations: int = 200, max_rows: int = 2000, min_rows: int = 50, seed: int = 0
) -> DataFrame:
    """One row over pairs with vectors p, c, r, delta (c - r), key, prompt and boolean columns masks; degenerate vectors end it early.

    val has the same columns but the masks, and keys of its own: with it come near duplicates within and across the sides,
    and the shift of each view; without it these are null. warnings names the rules that the report breaks.
    """
    spark = rows.sparkSession
    rows = checkpointed(rows)  # every block reads it
    health = _one_row(spark, [V.embedding_health(rows, "c").select("n_texts", "mean_norm", "frac_zero_vectors", "effective_rank", F.col("status").alias("health_status"))])
    if health.first().health_status != "ok":
        return health
    n = rows.count()
    views = {"prompt": "p", "chosen": "c", "rejected": "r"}
    keyed = rows.select(F.col("key").alias("key"), F.col("p").alias("v"))
    blocks = [
        health,
        V.separability_summary(V.separability(rows, masks, "delta", min_pairs, min_confident, seed=seed), n).withColumnRenamed("status", "separability_status"),
        V.delta_direction(rows, "delta").withColumnRenamed("status", "delta_status"),
        V.grounding(rows, "p", "c", "r", offtopic),
        V.mean_pairwise_cosine(rows, "c").select(F.col("mean_cosine").alias("mean_pairwise_cosine")),
    ]
    near = checkpointed(V.nearest(keyed, keyed, "key", "v", near_dup_tau))
    blocks.append(V.diversity(rows, views, near, isolated).withColumnRenamed("status", "diversity_status"))
    if val is not None:
        val = checkpointed(val)
        blocks.append(V.near_duplicates(keyed, val.select(F.col("key").alias("key"), F.col("p").alias("v")), "key", "v", near_dup_tau))
        shift = V.distribution_shift(rows, val, views, "key", permutations=permutations, max_rows=max_rows, min_rows=min_rows, seed=seed)
        wide = [F.max(F.when(F.col("name") == k, F.col(x))).alias(f"{x}_{k}") for k in views for x in ("mmd2", "p_value")]
        blocks.append(shift.agg(F.max("prompt_overlap_frac").alias("prompt_overlap_frac"), F.min("status").alias("shift_status"), *wide))
    report = _one_row(spark, blocks)
    for c in _WARNED:
        if c not in report.columns:
            report = report.withColumn(c, F.lit(None).cast("double"))
    if "shift_status" not in report.columns:
        report = report.withColumn("shift_status", F.lit("unavailable"))
    broken = V.profile_warnings(report).agg(F.array_sort(F.collect_list(F.struct("ord", "code"))).alias("w")).select(F.transform("w", lambda x: x["code"]).alias("warnings"))
    return report.crossJoin(broken)  # one row each


def diagnose(scored: DataFrame, masks: list[str], weights: np.ndarray, delta: str) -> DataFrame:
    """One row of Tier 2: the metrics of scored pairs, how the head lies in the deltas, and the worst slice."""
    worst = M.saturation_slices(scored, masks).agg(F.min_by("name", F.struct("accuracy", "name")).alias("worst_slice"), F.min("accuracy").alias("worst_accuracy"))
    return V.reward_directions(scored, delta, weights).withColumnRenamed("accuracy", "direction_accuracy").drop("n_pairs").crossJoin(M.pair_metrics(scored)).crossJoin(worst)
