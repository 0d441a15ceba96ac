"""The ledger: what the data predicted beside what training observed, and reference tables of log-probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContractError

#: Fixed values of the verdicts.
SLACK, ALL_SLICES, INFLATION, ERRORS = 0.005, 0.98, 1.1, 2


def build_ledger(audit: DataFrame, profile: DataFrame, run: DataFrame, slices: DataFrame) -> DataFrame:
    """ord, question, predicted, observed, verdict.

    One-row inputs: audit (baseline_best, baseline_best_acc, acc_char_length, p_longer_wins, frac_near_equal), profile
    (separability_raw, separability_min, frac_surface_controlled, pc1_share, prompt_overlap_frac), run (accuracy,
    accuracy_se, n_pairs, best_step, steps, early_stopped, wall_seconds, total_steps, cos_w_pc1, cos_w_mean_delta,
    pc1_explained_frac, rmax_first, rmax_last, shared_space). slices: name, n_pairs, accuracy, accuracy_se.
    """
    is_length = F.col("name").contains("len") | F.col("name").contains("word_count")
    entry = F.struct("accuracy", "name", "n_pairs", "accuracy_se")
    worst = slices.agg(F.min(entry).alias("worst"), F.min(F.when(is_length, entry)).alias("worst_len"))
    one = audit.drop(*run.columns).crossJoin(profile).crossJoin(run).crossJoin(worst)  # one row each
    c, f = F.col, F.format_string
    none = lambda x, text: F.coalesce(x, F.lit(text))
    rows = [
        ("how easy is this task", f("best baseline %s at %.3f; separability %.3f", "baseline_best", "baseline_best_acc", "separability_raw"), f("accuracy %.4f (se %.4f), best at step %d of %d", "accuracy", "accuracy_se", "best_step", "steps"),
         F.when(c("accuracy") >= c("baseline_best_acc") - SLACK, "confirmed: at the surface ceiling").otherwise("below the surface ceiling")),
        ("length shortcut", f("char_length %.3f; longer wins %.3f; near-equal pairs %.3f", "acc_char_length", "p_longer_wins", "frac_near_equal"),
         F.when(c("worst_len").isNull(), "no length slice with enough pairs").otherwise(f("worst length-matched slice %s at %.4f (n=%d, se %.4f)", "worst_len.name", "worst_len.accuracy", "worst_len.n_pairs", "worst_len.accuracy_se")),
         F.when(c("worst_len").isNull(), "n/a").when(c("worst_len.accuracy") >= c("accuracy") - ERRORS * F.greatest(c("worst_len.accuracy_se"), F.lit(1e-9)), "survives length control").otherwise("drops on length-controlled pairs")),
        ("surface-reader or not", f("surface-controlled pairs %.3f; separability_min %.3f", "frac_surface_controlled", "separability_min"), none(F.when(c("worst").isNotNull(), f("worst slice %s at %.4f (n=%d)", "worst.name", "worst.accuracy", "worst.n_pairs")), "no slices"),
         F.when(c("worst.accuracy") >= ALL_SLICES, "holds on every matched slice").otherwise("read the slices")),
        ("did it learn the first axis", f("first direction explains %.3f", "pc1_share"), f("cosine with it %+.3f, with the mean delta %+.3f, own share %.2f", "cos_w_pc1", "cos_w_mean_delta", "pc1_explained_frac"),
         F.when(c("shared_space"), "spaces are the same: comparable").when(~c("shared_space"), "spaces differ: not comparable").otherwise("as stated")),
        ("margin inflation", F.lit("margins grow after accuracy saturates"), none(F.when(c("rmax_first").isNotNull(), f("largest reward %.2f to %.2f", "rmax_first", "rmax_last")), "no curves"),
         F.when(c("rmax_last") > c("rmax_first") * INFLATION, "confirmed").otherwise("not observed")),
        ("honest evaluation", f("prompt overlap %.1f%%", 100 * c("prompt_overlap_frac")), f("%d pairs of other prompts", "n_pairs"), F.when(c("prompt_overlap_frac") == 0, "free of leakage").otherwise("prompts leak")),
        ("run facts", f("budget %d steps", "total_steps"), f("stopped early: %s, at step %d, %.0f s", c("early_stopped").cast("string"), "steps", "wall_seconds"), F.when(c("early_stopped"), "early stop saved the rest").otherwise("full budget")),
    ]
    each = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(q).alias("question"), p.alias("predicted"), o.alias("observed"), v.alias("verdict")) for i, (q, p, o, v) in enumerate(rows)))
    return one.select(F.explode(each).alias("x")).select("x.*")


def shared_space(run: dict, embed: dict) -> bool:
    """Whether a model was trained in the space that the data was measured in."""
    return all(run.get(k) == embed.get(k) for k in ("model_name", "pooling", "max_length")) and run.get("template") == "{response}"


def reference_lookup(pairs: DataFrame, cache: DataFrame, key: str = "uid") -> DataFrame:
    """pairs with ref_chosen and ref_rejected of the cache; a pair that the cache lacks is an error when the row is read."""
    found = pairs.join(cache.select(key, F.col("chosen").alias("ref_chosen"), F.col("rejected").alias("ref_rejected")), key, "left")
    miss = F.when(F.col("ref_chosen").isNull(), F.raise_error(F.concat(F.lit("no reference for "), F.col(key).cast("string"))).cast("double"))
    return found.withColumn("ref_chosen", F.coalesce("ref_chosen", miss))


def check_cache(header: dict, fingerprint: str, digest: str, length_norm: str) -> None:
    for name, want in (("fingerprint", fingerprint), ("data_digest", digest), ("length_norm", length_norm)):
        if header.get(name) != want:
            raise ContractError(f"the cache has {name} {header.get(name)!r}, this run {want!r}")


def embed_missing(texts: DataFrame, cache: DataFrame, embed) -> DataFrame:
    """sha, vector for every different text: those of the cache, and embed(texts without one) once each."""
    keyed = texts.select(F.sha2("text", 256).alias("sha"), "text").dropDuplicates(["sha"])
    known = keyed.join(cache.select("sha", "vector"), "sha").select("sha", "vector")
    return known.unionByName(embed(keyed.join(cache.select("sha"), "sha", "left_anti")).select("sha", "vector"))
