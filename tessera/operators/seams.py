"""Where models come in: scores of pairs, log-probabilities, generations. Each seam is a function over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, ContractError

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def score_pairs(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """pairs (prompt, chosen, rejected) with r_chosen and r_rejected; both sides of a batch in one call."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("r_chosen", T.DoubleType()), T.StructField("r_rejected", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = len(b)
            scores = [float(x) for x in scorer([*b.prompt, *b.prompt], [*b.chosen, *b.rejected])]
            if len(scores) != 2 * n:
                raise ContractError("a scorer gives one score for each response")
            yield b.assign(r_chosen=scores[:n], r_rejected=scores[n:])

    return pairs.mapInPandas(run, schema)


def generate(prompts: DataFrame, key: str, generator: Callable[[Sequence[str], int], Sequence[str]], samples: int = 1, greedy: bool = False) -> DataFrame:
    """key, sample, response: `samples` rows for each prompt. Greedy decoding gives one."""
    if greedy and samples > 1:
        raise ConfigError("greedy decoding has one sample")
    kind = prompts.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("sample", T.IntegerType()), T.StructField("response", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(samples):
                yield pd.DataFrame({key: b[key], "sample": k, "response": list(generator(b.prompt.tolist(), k)) if len(b) else []}).astype({"sample": "int32"})

    return prompts.select(key, "prompt").mapInPandas(run, schema)


#: Names that results have of their own.
RESERVED = {"sample", "response"}


def generate_missing(prompts: DataFrame, done: DataFrame, key: str, generator: Callable[[Sequence[str], int], Sequence[str]]) -> DataFrame:
    """Greedy generations of the prompts that done lacks."""
    if clash := RESERVED & set(prompts.columns):
        raise ConfigError(f"columns {sorted(clash)} are the results' own")
    return generate(prompts.join(done.select(key), key, "left_anti"), key, generator, greedy=True)


def generate_resumable(prompts: DataFrame, path: str, key: str, generator: Callable[[Sequence[str], int], Sequence[str]]) -> DataFrame:
    """All results at path, after those that it lacks were generated and appended; a run that ended early is taken up again."""
    spark = prompts.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    kind = T.StructType([prompts.schema[key], T.StructField("sample", T.IntegerType()), T.StructField("response", T.StringType())])
    done = spark.read.schema(kind).parquet(path) if there else spark.createDataFrame([], kind)
    generate_missing(prompts, done, key, generator).write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)


def memoised(rows: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what compute adds to (sha, text), which sees every different text once; for functions that cost more than a join."""
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    keyed = rows.withColumn("sha", sha)
    made = compute(keyed.select("sha", F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["sha"])).drop("text")
    return keyed.join(made, "sha").drop("sha")


def reward_head(hidden: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """The linear head over a pooled vector."""
    from ..functions.numbers import dot

    return dot(hidden, F.array(*(F.lit(float(w)) for w in weights))) + F.lit(float(bias))
