"""Positions in a total order, without bringing rows into one task: indices, exact quantiles, top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Results of a few rows for each partition or rule are joined by broadcast up to so many rows.
SMALL = 100_000


def with_index(df: DataFrame, keys: list, name: str = "index", start: int = 0) -> DataFrame:
    """df with consecutive numbers from `start` by `keys` (columns that order the rows totally).

    Rows are range-partitioned and sorted; each partition numbers its own, and counts of the partitions before it are added.
    Of rows that are equal in all keys any order will do: their place in the input is the last key, so that a frequent value
    is dealt over many ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id of a row is its partition << 33 | its place there; kept, as other ranges could come out of another run
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    local = checkpointed(keyed.repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted(local.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    base, offsets = start, []
    for p, k in counts:
        offsets.append((int(p), base))
        base += k
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _base bigint")
    out = local.withColumn("_part", part).join(F.broadcast(table), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_id")


#: Rules for quantile q of n values: the position in ascending order, which may lie between two values.
Rule = Callable[[Column], Column]


def floor_rule(q: float) -> Rule:
    return lambda n: F.least(F.floor(F.lit(float(q)) * n), n - 1).cast("double")


def linear_rule(q: float) -> Rule:
    return lambda n: F.lit(float(q)) * (n - 1)


def lower_rule(q: float = 0.5) -> Rule:
    return lambda n: F.greatest(F.ceil(F.lit(float(q)) * n) - 1, F.lit(0).cast("bigint")).cast("double")


def upper_middle_rule() -> Rule:
    return lambda n: F.floor(n / 2).cast("double")


def banker_rule(q: float) -> Rule:
    return lambda n: F.bround(F.lit(float(q)) * (n - 1)).cast("double")


def quantiles(df: DataFrame, value: str, rules: dict[str, Rule], by: list[str] | None = None) -> DataFrame:
    """One row for each group (or one in all) with a column for each rule; values between two are interpolated.

    Nulls do not count; without values there is no row.
    """
    by = by or []
    rows = with_index(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), [*by, "_v"], "_i")
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_i").alias("_first")).where("_n > 0")
    at = F.array(*(F.struct(F.lit(k).alias("rule"), rule(F.col("_n")).alias("at")) for k, rule in rules.items()))
    wanted = groups.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_first", F.explode(at).alias("_w")).select(
        *(f"_by_{c}" for c in by), F.col("_w.rule").alias("_rule"), F.explode(F.array(F.struct((F.col("_first") + F.floor("_w.at")).alias("i"), (1 - (F.col("_w.at") - F.floor("_w.at"))).alias("weight")), F.struct((F.col("_first") + F.ceil("_w.at")).alias("i"), (F.col("_w.at") - F.floor("_w.at")).alias("weight")))).alias("_p")
    )
    found = wanted.join(rows.select(F.col("_i"), "_v"), F.col("_p.i") == F.col("_i"))
    part = F.col("_v") * F.col("_p.weight")
    # named columns, as pivot would first look for its values
    return found.groupBy(*(F.col(f"_by_{c}").alias(c) for c in by)).agg(*(F.sum(F.when((F.col("_rule") == k) & (F.col("_p.weight") > 0), part)).alias(k) for k in rules))


def top_k(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    """The first k rows; keys must order all rows. Each partition gives k rows at most."""
    return df.orderBy(*keys).limit(k)
