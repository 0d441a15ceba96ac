"""What parts expect of tables, checked in the plan itself: a broken row fails the query that reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractError


def need_columns(df: DataFrame, **types: str) -> DataFrame:
    have = dict(df.dtypes)
    for name, kind in types.items():
        if have.get(name) != kind:
            raise ContractError(f"column {name} is {have.get(name, 'missing')}, not {kind}")
    return df


def _guard(df: DataFrame, column: str, bad: Column, what: str) -> DataFrame:
    kind = df.schema[column].dataType
    message = F.concat(F.lit(f"{column} {what}: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return df.withColumn(column, F.when(F.coalesce(bad, F.lit(True)), F.raise_error(message).cast(kind)).otherwise(F.col(column)))


def need_finite(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = _guard(df, c, F.isnan(c) | (F.abs(c) == float("inf")), "is not finite")
    return df


def need_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return _guard(df, column, ~F.col(column).between(low, high), f"is not in [{low}, {high}]")


def need_length(df: DataFrame, column: str, n: int) -> DataFrame:
    kind = df.schema[column].dataType
    bad = F.coalesce(F.size(column) != n, F.lit(True))
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit(f"{column} has not {n} values")).cast(kind)).otherwise(F.col(column)))


def need_unique(df: DataFrame, *keys: str) -> DataFrame:
    if twice := df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").first():
        raise ContractError(f"{keys} occurs {twice.n} times: {[twice[k] for k in keys]}")
    return df
