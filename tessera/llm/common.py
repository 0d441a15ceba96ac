"""What the text operators share: input columns, shared folders, Arrow batches cut by bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step works on at a time (one document at least).
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch; with long texts, a small number bounds the memory of a batch.
BATCH_ROWS = 500


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and there is no cluster, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            sc.setCheckpointDir(base)
    return base


def folder_of(spark: SparkSession, name: str) -> str:
    """A path in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{name}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Stored:
    """A DataFrame written as Parquet in the shared folder; drop() deletes it."""

    def __init__(self, df: DataFrame, name: str, compression: str = "zstd"):
        self.spark = df.sparkSession
        self.path = folder_of(self.spark, f"{name}-{uuid.uuid4().hex}")
        df.write.option("compression", compression).parquet(self.path)
        self.df = self.spark.read.parquet(self.path)

    def drop(self) -> None:
        removed(self.spark, self.path)


def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows, so that a batch of long texts fits in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def byte_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes of text each, or one row."""
    n = len(column)
    if not n:
        return
    sizes = np.fromiter((len(x) if x is not None else 0 for x in column.cast(pa.binary()).to_pylist()), np.int64, n)
    start, total = 0, 0
    for i in range(n):
        if i > start and total + sizes[i] > limit:
            yield start, i
            start, total = i, 0
        total += sizes[i]
    yield start, n


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in byte_slices(batch.column(batch.schema.get_field_index(text)), limit):
            yield batch.slice(a, b - a)


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null texts are empty."""
    return [x or "" for x in col(batch, name).to_pylist()]


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5. A null id is never learnt from, so it counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def segments(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 within each segment, for segments of these lengths one after the other."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(starts, lengths)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        m = max(n, 2 * len(_POWERS[0]))
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for every span of a byte array, by differences of one prefix polynomial."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(data: np.ndarray, starts: list[np.ndarray], ends: np.ndarray | slice) -> list[np.ndarray]:
    """Hashes of data[start:end] as in span_hashes, but neither mixed nor told apart by length, for several starts of each end."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    last = prefix[ends]
    return [(last - prefix[s]) * down[s] for s in starts]


#: Bytes 0x20 and 0x09 to 0x0D, which separate words; A-Z in lower case.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each closed by a newline; starts and ends of the words; the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = LOWER[data]
    gap = np.ones(len(data) + 1, bool)
    gap[1:] = SEPARATOR[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0) if texts else np.zeros(0, np.int64)
    return data, starts, ends, counts


def extra(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of df that are not called like one of names in any case, as Spark does not tell such names apart."""
    taken = {x.lower() for x in names}
    return [c for c in df.columns if c.lower() not in taken]


def free(columns: list[str], name: str) -> str:
    """name, or that with underscores before it, so that it is none of columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name as SQL reads it, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def numbered(df: DataFrame, new: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """The columns of df under the names _0, _1, ..., and their own names; without those called like one of new in any case.

    Functions over Arrow batches do not take names with dots, and Spark does not tell names apart by case.
    """
    names = extra(df, new)
    return df.select(*(F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(names))), names


def beside(df: DataFrame, new: dict[str, str], work: Callable[[pa.RecordBatch], list[pa.Array]], limit: int) -> DataFrame:
    """df with the columns new (name to type), which work makes of batches whose column text has up to limit bytes.

    Columns of df called like one of new, in any case, are replaced; all others come back unchanged under their own names.
    """
    rows, names = numbered(df, tuple(new))
    place = [n.lower() for n in names].index("text")
    schema = StructType(list(rows.schema))
    for name, kind in new.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, f"_{place}", limit):
            given = batch.rename_columns(["text" if i == place else n for i, n in enumerate(batch.schema.names)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(given)], names=[*batch.schema.names, *new])

    return rows.mapInArrow(run, schema).toDF(*names, *new)
