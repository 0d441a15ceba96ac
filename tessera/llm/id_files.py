"""Token-ID files: canonical length-limited Huffman coding of ids from global counts.

write() range-sorts documents by doc_id, encodes them, counts all ids, and stores shards of whole documents (see huffman)
with the code lengths beside them; read() decodes every shard by table and returns a row for each document. The shards
are rows of a Parquet table because Spark commits those atomically to any store, so a task can fail and run again.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_ids, huffman
from .common import Stored, batch_rows, chunks, col, documents, partitions, shared_dir, texts_of

END_ID = 2
#: Ids after which a shard is closed, at the end of a document.
SHARD_IDS = 1 << 18

_SHARD = "part int, seq int, within long, n_ids long, doc_ids binary, null_ids binary, doc_lengths binary, ids binary"


def _tokens(docs: DataFrame, path: str, pattern: str, end_id: int, shard_ids: int) -> DataFrame:
    """Documents in ascending doc_id as shards of ids; within: ids of the same partition before the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = bpe_ids.encoder(path, pattern), TaskContext.get().partitionId()
        narrow = "<u2" if enc.n_vocab <= 1 << 16 else "<u4"
        seq, within, n, doc_ids, ids = 0, 0, 0, [], []

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids], "<i8")
            row = [part, seq, within, n, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], bool).tobytes(), lengths.tobytes(), np.concatenate(ids).astype(narrow).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=["part", "seq", "within", "n_ids", "doc_ids", "null_ids", "doc_lengths", "ids"])

        for batch in chunks(batches):
            for doc_id, text in zip(col(batch, "doc_id").to_pylist(), texts_of(batch)):
                doc_ids.append(doc_id)
                ids.append(bpe_ids.encode(enc, text, end_id))
                n += len(ids[-1])
                if n >= shard_ids:
                    yield shard()
                    seq, within, n, doc_ids, ids = seq + 1, within + n, 0, [], []
        if ids:
            yield shard()

    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return sorted_docs.mapInArrow(run, _SHARD)


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def write(docs: DataFrame, path: str, folder: str, pattern: str = public_tokenizers.PATTERN, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Writes the id files of docs (doc_id, text, and any other columns, which are ignored) to folder.

    Null and empty texts have only the end id. Null ids come first; rows with equal ids keep an order by text.
    An empty table gives files without shards.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    stored = Stored(_tokens(docs, path, pattern, end_id, shard_ids), "tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for raw, n in zip(col(batch, "ids").to_pylist(), col(batch, "n_ids").to_pylist()):
                found = np.bincount(_ids(raw, n))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    # one row for each id of the vocabulary at most, and one for each partition
    counted = stored.df.select("n_ids", "ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r.id for r in counted), default=0), np.int64)
    for r in counted:
        counts[r.id] = r.n
    lengths = huffman.code_lengths(counts)
    codes = huffman.canonical(lengths)
    sizes = dict(stored.df.groupBy("part").agg(F.sum("n_ids")).collect())
    first, before = {}, 0
    for part in sorted(sizes):
        first[part] = before
        before += sizes[part]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                payload = huffman.encode(_ids(r["ids"], r["n_ids"]), np.frombuffer(r["doc_lengths"], "<i8"), first[r["part"]] + r["within"], lengths, codes)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["seq"]], pa.int32()), pa.array([r["doc_ids"]]), pa.array([r["null_ids"]]), pa.array([payload])], names=["part", "seq", "doc_ids", "null_ids", "payload"])

    shards = stored.df.select("part", "seq", "within", "n_ids", "doc_ids", "null_ids", "doc_lengths", "ids")
    shards.mapInArrow(encode, "part int, seq int, doc_ids binary, null_ids binary, payload binary").write.parquet(f"{folder}/shards")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/codebook")
    stored.drop()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids binary (little-endian unsigned 32-bit) of the documents."""
    batch_rows(spark)
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/codebook").first().lengths, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoding = huffman.table(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                ids, sizes, first = huffman.decode(r["payload"], decoding)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                none = np.frombuffer(r["null_ids"], bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=none), pa.array(starts + first, pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends)], pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    return spark.read.parquet(f"{folder}/shards").mapInArrow(run, "doc_id long, start long, ids binary")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read() returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = col(batch, "ids").to_pylist()
            yield pa.RecordBatch.from_arrays([col(batch, "doc_id"), col(batch, "start"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tessera/id-files-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return digests(read(spark, folder))
