"""Streams over folders of files: groups as they arrive, with what cannot be one beside them, and windows over a log.

The batch operators apply to streams as they are; what is here adds checkpoints, late data and state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.formats import FieldMap, to_groups


def read_records(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(records: DataFrame, layout: str, out: str, rejects: str, checkpoint: str, names: FieldMap | None = None, slice_keys: list[str] | None = None) -> StreamingQuery:
    """Groups to out and rows with a reason to rejects, as Parquet; each batch is written once, however often it is tried."""
    groups = to_groups(records, layout, names, slice_keys)

    def write(batch: DataFrame, epoch: int) -> None:
        # one folder for each batch, overwritten by a second try
        for rows, path in ((batch.where("reason is null").drop("reason"), out), (batch.where("reason is not null"), rejects)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return groups.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, value: str, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows and sums by window and key; rows later than `late` after the newest don't count."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), key, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
