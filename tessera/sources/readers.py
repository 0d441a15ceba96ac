"""Records from files and memory, with a schema that is given, never guessed from the data."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, DataError


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def scan_memory(spark: SparkSession, rows: list[dict[str, Any]], schema: str | T.StructType) -> DataFrame:
    names = _schema(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], _schema(schema))


def scan_dataset(spark: SparkSession, dataset: Any, schema: str | T.StructType | None = None) -> DataFrame:
    """Anything with column_names and to_pandas(), as data-set libraries have."""
    if not hasattr(dataset, "column_names") or not hasattr(dataset, "to_pandas"):
        raise ConfigError("a dataset needs column_names and to_pandas()")
    return spark.createDataFrame(dataset.to_pandas(), _schema(schema) if schema else None)


def scan_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, bad: str = "fail") -> DataFrame:
    """One record a line, with file and row, which rises with the lines of a file. Blank lines don't count.

    bad: `fail` raises at the first line that is no JSON, naming the file; `keep` leaves it in _corrupt.
    """
    own = _schema(schema)
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row")).where(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", T.StructType([*own.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = parsed.select("file", "row", "_r.*")
    if bad == "fail":
        message = F.concat(F.col("file"), F.lit(": not JSON: "), F.substring("_corrupt", 1, 80))
        rows = rows.withColumn(own.names[0], F.when(F.col("_corrupt").isNotNull(), F.raise_error(message).cast(own.fields[0].dataType)).otherwise(F.col(own.names[0]))).drop("_corrupt")
    elif bad != "keep":
        raise ConfigError(f"unknown way with bad lines: {bad!r}")
    return rows


def scan_json(spark: SparkSession, path: str, schema: str | T.StructType, json_key: str | None = None) -> DataFrame:
    """A file that is a list of records, or a record with such a list under json_key."""
    own = _schema(schema)
    if json_key is None:
        return spark.read.schema(own).option("multiLine", True).option("mode", "FAILFAST").json(path)
    outer = T.StructType([T.StructField(json_key, T.ArrayType(own))])
    whole = spark.read.schema(outer).option("multiLine", True).json(path)
    if whole.where(F.col(json_key).isNotNull()).limit(1).count() == 0:
        raise ConfigError(f"{path} has no list under {json_key!r}")
    return whole.select(F.explode(json_key).alias("r")).select("r.*")


def scan_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """With a header; all columns are strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan(spark: SparkSession, path: str, schema: str | T.StructType, json_key: str | None = None) -> DataFrame:
    """By the file's ending."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end == "jsonl":
        return scan_jsonl(spark, path, schema)
    if end == "json":
        return scan_json(spark, path, schema, json_key)
    if end == "csv":
        return scan_csv(spark, path, _schema(schema).names)
    if end == "parquet":
        return scan_parquet(spark, path)
    raise ConfigError(f"unknown kind of file: {path}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def scan_metrics(spark: SparkSession, path: str) -> DataFrame:
    """file, line, step, t, metrics (map<string,string>) of metric logs; a step may occur more than once."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), F.from_json("value", "map<string,string>").alias("m")).where(F.col("m").isNotNull())
    return rows.select("file", "line", F.col("m")["step"].cast("bigint").alias("step"), F.col("m")["t"].cast("double").alias("t"), F.map_filter("m", lambda k, v: ~k.isin("step", "t")).alias("metrics"))


def union_files(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise DataError("there are no inputs")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
