"""Groups to (chosen, rejected) pairs: ranks, three policies, counts without expansion, samples, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.numbers import hash_unit

POLICIES = ("all_pairs", "best_vs_rest", "adjacent")


def ranks_from_scores(scores: Column) -> Column:
    """Competition ranks from 0, the highest score first; equal scores share a rank."""
    return F.transform(scores, lambda s: F.size(F.filter(scores, lambda t: t > s)))


def effective_ranking(ranking: Column, scores: Column) -> Column:
    """The ranking if there is one, else ranks of the scores, else null."""
    return F.coalesce(ranking, F.when(scores.isNotNull(), ranks_from_scores(scores)))


def best_index(ranks: Column) -> Column:
    return (F.array_position(ranks, F.array_min(ranks)) - 1).cast("int")


def has_signal(ranks: Column) -> Column:
    return F.coalesce(F.array_min(ranks) != F.array_max(ranks), F.lit(False))


def group_flags(groups: DataFrame) -> DataFrame:
    """groups with k, has_ranking, has_scores, ranks, best_index, has_signal."""
    rows = groups.withColumn("ranks", effective_ranking(F.col("ranking"), F.col("scores")))
    return rows.select("*", F.size("responses").alias("k"), F.col("ranking").isNotNull().alias("has_ranking"), F.col("scores").isNotNull().alias("has_scores"), best_index(F.col("ranks")).alias("best_index"), has_signal(F.col("ranks")).alias("has_signal"))


def _policy(name: str) -> str:
    if name not in POLICIES:
        raise ConfigError(f"unknown policy {name!r}; known: {POLICIES}")
    return name


def pair_uid(group: Column, chosen: Column, rejected: Column) -> Column:
    """group * 10**6 + chosen * 10**3 + rejected; both indices must be below 1000."""
    ok = F.assert_true((chosen < 1000) & (rejected < 1000), "indices of a pair must be below 1000")
    return F.coalesce(ok.cast("bigint"), group.cast("bigint") * 1_000_000 + chosen * 1_000 + rejected)


def to_pairs(groups: DataFrame, policy: str = "all_pairs", max_pairs: int | None = None, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of every group, in the row itself: no shuffle unless they are sampled. Each has its group's columns of carry too.

    max_pairs keeps a uniform sample of so many pairs of each group, by a hash of seed and pair.
    """
    _policy(policy)
    rows = groups.withColumn("_r", effective_ranking(F.col("ranking"), F.col("scores"))).where(F.col("_r").isNotNull())
    rows = rows.withColumn("_levels", F.array_sort(F.array_distinct("_r")))
    r = F.col("_r")
    indices = F.sequence(F.lit(0), F.size(r) - 1)

    def better(i: Column, j: Column) -> Column:
        a, b = F.get(r, i), F.get(r, j)
        if policy == "all_pairs":
            return a < b
        if policy == "best_vs_rest":
            return (a == F.array_min(r)) & (b > a)
        return F.array_position(F.col("_levels"), b) == F.array_position(F.col("_levels"), a) + 1

    both = F.flatten(F.transform(indices, lambda i: F.transform(F.filter(indices, lambda j: better(i, j)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    if max_pairs is not None:
        ordered = F.array_sort(F.transform(both, lambda p: F.struct(F.xxhash64(F.lit(seed), F.col("uid"), p["i"], p["j"]).alias("h"), p.alias("p"))))
        both = F.array_sort(F.transform(F.slice(ordered, 1, max_pairs), lambda x: x["p"]))
    rows = rows.select("uid", "prompt", "responses", "scores", "slices", *carry, F.explode(both).alias("_p"))
    i, j = F.col("_p.i"), F.col("_p.j")
    return rows.select(
        pair_uid(F.col("uid"), i, j).alias("pair_uid"), F.col("uid").alias("group_uid"), i.alias("chosen_idx"), j.alias("rejected_idx"), "prompt", F.get("responses", i).alias("chosen"), F.get("responses", j).alias("rejected"), "slices",
        (F.get("scores", i) - F.get("scores", j)).alias("margin_hint"), *carry,
    )


def count_pairs(groups: DataFrame) -> DataFrame:
    """uid and the number of pairs under each policy, from the sizes of the levels alone."""
    rows = groups.withColumn("_r", effective_ranking(F.col("ranking"), F.col("scores"))).where(F.col("_r").isNotNull())
    r = F.col("_r")
    sizes = F.transform(F.array_sort(F.array_distinct(r)), lambda v: F.size(F.filter(r, lambda x: x == v)).cast("bigint"))
    rows = rows.select("uid", F.size(r).cast("bigint").alias("_k"), sizes.alias("_s"))
    s, k = F.col("_s"), F.col("_k")
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    steps = F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda a, b: a * F.coalesce(b, F.lit(0).cast("bigint")))
    return rows.select("uid", ((k * k - total(F.transform(s, lambda x: x * x))) / 2).cast("bigint").alias("all_pairs"), (F.get(s, F.lit(0)) * (k - F.get(s, F.lit(0)))).alias("best_vs_rest"), total(steps).alias("adjacent"))


def uniform_sample(pairs: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (all, if there are fewer) by a hash of seed and key; each task gives n rows at most."""
    return pairs.orderBy(hash_unit(F.concat(F.lit(f"{seed} "), F.col(key).cast("string"))), key).limit(n)
