"""tessera VERB [--config FILE] [--set key=value ...]: resplit, audit, profile, train, eval, diagnose, ledger, push, pull. Errors of configuration or data exit with 2."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .errors import ConfigError, DataError
from .operators import audit as A
from .functions import numbers
from .operators import dpo_train, formats, metrics, pairs, splits, vectors
from .operators import ledger as receipts
from .operators import profile as tiers
from .session import checkpointed, session
from .sources import readers, runs, sinks

#: Steps of a fit at most.
STEPS = 50
#: Verbs that read no training pairs.
WITHOUT_DATA = {"ledger", "push", "pull"}


def _folder(cfg: C.Config) -> str:
    return f"{cfg.out_dir}/{cfg.run_name}"


def _groups(spark: SparkSession, cfg: C.Config, path: str) -> DataFrame:
    rows = readers.scan(spark, path, cfg.data.schema, cfg.data.json_key)
    order = ["file", "row"] if "row" in rows.columns else ["prompt"]
    return formats.load_groups(rows, cfg.data.layout, formats.FieldMap.of(cfg.data.fields), list(cfg.data.slice_keys), cfg.data.max_drop_rate, order=order)


def resplit(spark: SparkSession, cfg: C.Config) -> list[str]:
    """Train and validation records that share no prompt. Rows are duplicates if all columns of the records are equal, in whichever
    file and line they are; the first in the order of the scan stays."""
    rows = readers.scan(spark, cfg.data.train_path, cfg.data.schema, cfg.data.json_key)
    own = [c for c in rows.columns if c not in ("file", "row")]
    place = F.struct("file", "row") if "row" in rows.columns else F.monotonically_increasing_id()
    rows = rows.select(*(F.col(f"`{c}`") for c in own), place.alias("_place"))
    split = checkpointed(splits.split_records(rows, "_place", cfg.split.val_frac, cfg.split.method, cfg.split.seed, cfg.data.prompt_field, cfg.split.drop_exact_duplicates))
    for name, keep in (("train", ~F.col("is_val")), ("val", F.col("is_val"))):
        sinks.sink_records(split.where(keep).select(*(F.col(f"`{c}`") for c in own)), f"{_folder(cfg)}/{name}", "overwrite")
    report = sinks.sink_report(splits.split_report(split, cfg.data.prompt_field), f"{_folder(cfg)}/split_report.json")
    return [f"{k:>24} {v}" for k, v in report.items()]


def audit(spark: SparkSession, cfg: C.Config) -> list[str]:
    groups = checkpointed(_groups(spark, cfg, cfg.data.train_path))
    val = _groups(spark, cfg, cfg.data.val_path) if cfg.data.val_path else None
    report = checkpointed(A.audit(groups, checkpointed(pairs.to_pairs(groups)), val, cfg.audit.expected_ceiling))
    values = sinks.sink_report(report, f"{_folder(cfg)}/audit_report.json")
    warnings = [f"! {r.code}: {r.message}" for r in A.audit_warnings(report).orderBy("ord").collect()]
    return [f"{k:>24} {v}" for k, v in values.items()] + warnings


#: Columns of a table that hold the log-probabilities of both sides under the policy and under the reference.
STORED = ("policy_chosen", "policy_rejected", "ref_chosen", "ref_rejected")


def _stored(groups: DataFrame, layout: str) -> tuple[str, ...]:
    """STORED, if the groups' table has these columns, or nothing, if it has none of them. They are of one pair each, so records with
    more responses can't have them, and some of them alone are an error."""
    there = [c for c in STORED if c in groups.columns]
    if there and len(there) < len(STORED):
        raise DataError(f"of the stored log-probabilities {[c for c in STORED if c not in there]} are missing")
    if there and layout.startswith("kway"):
        raise DataError(f"log-probabilities of pairs can't be stored in layout {layout}")
    return tuple(there)


def _embedded(spark: SparkSession, cfg: C.Config, path: str) -> DataFrame:
    """At most max_samples pairs by a hash of their id (the sample is the feature; no other bound applies), with vectors of the hashing
    encoder and the log-probabilities that the table stores."""
    p = cfg.profile
    groups = _groups(spark, cfg, path)
    made = pairs.to_pairs(groups, cfg.policy, carry=_stored(groups, cfg.data.layout))
    rows = pairs.uniform_sample(made, "pair_uid", p.max_samples, p.seed)
    for side, name in (("prompt", "p"), ("chosen", "c"), ("rejected", "r")):
        rows = vectors.hash_embed(rows, side, p.width, name)
    return checkpointed(rows.withColumn("delta", F.zip_with("c", "r", lambda a, b: a - b)).withColumn("key", F.col("pair_uid")))


def profile(spark: SparkSession, cfg: C.Config) -> list[str]:
    """Tier 1, with the validation side where data.val_path is set."""
    p = cfg.profile
    masked, names = vectors.slice_masks(_embedded(spark, cfg, cfg.data.train_path), p.eps)
    val = _embedded(spark, cfg, cfg.data.val_path).withColumn("key", -1 - F.col("key")) if cfg.data.val_path else None
    report = tiers.profile(masked, names, p.min_pairs, p.min_confident, p.isolated_tau, p.offtopic_tau, val, p.near_dup_tau, p.mmd_n_perm, p.mmd_max_n, p.mmd_min_n, p.seed)
    values = sinks.sink_report(report, f"{_folder(cfg)}/profile_report.json")
    return [f"{k:>40} {v}" for k, v in values.items()]


def _scored(spark: SparkSession, cfg: C.Config, path: str) -> DataFrame:
    """Pairs with the hashing encoder's vectors and the four log-probabilities that the table stores, as numbers; each must be there and
    finite. A table without these columns gives 0 for all: then the head starts from no model at all."""
    rows = _embedded(spark, cfg, path)
    if STORED[0] not in rows.columns:
        return rows.withColumns({c: F.lit(0.0) for c in STORED})
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in STORED})
    bad = {c: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in STORED}
    if faults := {c: n for c, n in rows.agg(*bad.values()).first().asDict().items() if n}:
        raise DataError(f"stored log-probabilities that are no finite numbers, by column: {faults}")
    return rows


def train(spark: SparkSession, cfg: C.Config) -> list[str]:
    """A DPO head over the hashing encoder's differences; its curve, and the weights for eval."""
    if not cfg.data.val_path:
        raise ConfigError("data.val_path is not set")
    began = time.monotonic()
    found = dpo_train.fit(_scored(spark, cfg, cfg.data.train_path), _scored(spark, cfg, cfg.data.val_path), steps=STEPS)
    folder = _folder(cfg)
    sinks.write_json(f"{folder}/head.json", {"weights": found.weights.tolist(), "best_step": found.best_step, "width": cfg.profile.width})
    values = {"steps": found.steps, "total_steps": STEPS, "best_step": found.best_step, "stopped_early": found.stopped_early}
    values |= {"wall_seconds": time.monotonic() - began, "curve": [list(c) for c in found.curve]}
    sinks.write_json(f"{folder}/train_report.json", values)
    return [f"{k:>24} {v}" for k, v in values.items()]


def _receipt(cfg: C.Config, name: str, verb: str):
    path = Path(_folder(cfg), name)
    if not path.exists():
        raise ConfigError(f"{path} is missing: {verb} first")
    return json.loads(path.read_text())


def _judged(spark: SparkSession, cfg: C.Config) -> tuple[DataFrame, list[float]]:
    """The validation pairs (the training pairs, where there are no others) with the stored head's rewards, and its weights."""
    weights = [float(x) for x in _receipt(cfg, "head.json", "train")["weights"]]
    head = F.array(*(F.lit(x) for x in weights))
    rows = _scored(spark, cfg, cfg.data.val_path or cfg.data.train_path)
    return rows.withColumns({"r_chosen": numbers.dot(F.col("c"), head), "r_rejected": numbers.dot(F.col("r"), head)}), weights


def evaluate(spark: SparkSession, cfg: C.Config) -> list[str]:
    """Metrics of the stored head."""
    values = sinks.sink_report(metrics.pair_metrics(_judged(spark, cfg)[0].select("r_chosen", "r_rejected")), f"{_folder(cfg)}/eval_report.json")
    return [f"{k:>24} {v}" for k, v in values.items()]


def diagnose(spark: SparkSession, cfg: C.Config) -> list[str]:
    """Tier 2 of the stored head: its metrics, how it lies in the deltas, and its accuracy on every matched slice."""
    rows, weights = _judged(spark, cfg)
    masked, names = vectors.slice_masks(rows, cfg.profile.eps)
    masked = checkpointed(masked)
    values = sinks.sink_report(tiers.diagnose(masked, names, np.array(weights), "delta"), f"{_folder(cfg)}/diagnose_report.json")
    slices = metrics.saturation_slices(masked, names, cfg.profile.min_pairs).orderBy("name").collect()  # a row for each mask at most
    sinks.write_json(f"{_folder(cfg)}/slices.json", [r.asDict() for r in slices])
    return [f"{k:>24} {v}" for k, v in values.items()] + [f"{r.name:>24} {r.accuracy:.4f} of {r.n_pairs}" for r in slices]


#: What the ledger takes of each receipt: our column, the receipt's key, its type.
_AUDITED = [(k, k, "string" if k == "baseline_best" else "double") for k in ("baseline_best", "baseline_best_acc", "acc_char_length", "p_longer_wins", "frac_near_equal")]
_PROFILED = [(k, k, "double") for k in ("separability_raw", "separability_min", "frac_surface_controlled", "pc1_share", "prompt_overlap_frac")]
_TRAINED = [("best_step", "best_step", "int"), ("steps", "steps", "int"), ("total_steps", "total_steps", "int"), ("early_stopped", "stopped_early", "boolean"), ("wall_seconds", "wall_seconds", "double")]
_DIAGNOSED = [("n_pairs", "n_pairs", "long"), *((k, k, "double") for k in ("accuracy", "accuracy_se", "cos_w_pc1", "cos_w_mean_delta", "pc1_explained_frac", "rmax_first", "rmax_last"))]


def _row(spark: SparkSession, values: dict, taken: list[tuple[str, str, str]]) -> DataFrame:
    """One row with the taken values of a receipt; null where it has none."""
    row = tuple(float(v) if (v := values.get(key)) is not None and kind == "double" else v for _, key, kind in taken)
    return spark.createDataFrame([row], ", ".join(f"{name} {kind}" for name, _, kind in taken))


def ledger(spark: SparkSession, cfg: C.Config) -> list[str]:
    """What the receipts of audit and profile predicted beside what those of train and diagnose observed."""
    audited, profiled = _receipt(cfg, "audit_report.json", "audit"), _receipt(cfg, "profile_report.json", "profile")
    trained, seen = _receipt(cfg, "train_report.json", "train"), _receipt(cfg, "diagnose_report.json", "diagnose")
    # one encoder measures the data and trains the head, on responses alone
    run = _row(spark, trained, _TRAINED).crossJoin(_row(spark, seen, _DIAGNOSED)).withColumn("shared_space", F.lit(True))  # one row each
    of = "name string, n_pairs long, accuracy double, accuracy_se double"
    slices = spark.createDataFrame([tuple(s[k.split()[0]] for k in of.split(", ")) for s in _receipt(cfg, "slices.json", "diagnose")], of)
    rows = receipts.build_ledger(_row(spark, audited, _AUDITED), _row(spark, profiled, _PROFILED), run, slices).orderBy("ord").collect()  # seven
    sinks.write_json(f"{_folder(cfg)}/ledger.json", [r.asDict() for r in rows])
    return [f"{r.question}: {r.predicted} | {r.observed} | {r.verdict}" for r in rows]


def push(spark: SparkSession, cfg: C.Config) -> list[str]:
    """Copies the run's folder to the store."""
    return [f"{k:>24} {v}" for k, v in runs.push(_folder(cfg), cfg.store, cfg.run_name).items()]


def pull(spark: SparkSession, cfg: C.Config) -> list[str]:
    """Copies the run's folder from the store."""
    return [f"{k:>24} {v}" for k, v in runs.pull(cfg.store, cfg.run_name, _folder(cfg)).items()]


VERBS = {"resplit": resplit, "audit": audit, "profile": profile, "train": train, "eval": evaluate, "diagnose": diagnose, "ledger": ledger, "push": push, "pull": pull}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("tessera", description=__doc__)
    parser.add_argument("verb", choices=sorted(VERBS))
    parser.add_argument("--config")
    parser.add_argument("--set", nargs="*", default=[])
    args = parser.parse_args(argv)
    try:
        cfg = C.load(args.config, args.set)
        if not cfg.data.train_path and args.verb not in WITHOUT_DATA:
            raise ConfigError("data.train_path is not set")
        print("\n".join(VERBS[args.verb](spark or session(), cfg)))
    except (ConfigError, DataError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0
