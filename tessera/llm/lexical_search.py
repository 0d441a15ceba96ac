"""Ranked lexical search: compressed postings by shard, merged a document at a time, and the shards' best merged over all.

build() cuts the documents of each partition into shards and writes for every shard its documents, in ascending doc_id, and for
every term of it the postings: gaps between places in that order, and occurrences, as variable-length integers. search() takes
the postings of the queries' terms, shard by shard; a k-way heap merge meets the documents in ascending doc_id and keeps the
best ones of each query in a bounded heap, keyed by score, then doc_id. Terms whose greatest scores together cannot lift a
document into the heap do not lead the merge (they are looked up for documents that others lead to), so results are exact.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored, batch_rows, chunks, col, documents, folder_of, removed, texts_of

#: Terms (with repeats) after which a shard is closed, at the end of a document.
SHARD_TERMS = 1 << 22
#: Pairs of query and term that are searched together; the driver and each task hold one such block.
BLOCK_TERMS = 1 << 17
TOP = 20

#: Fixed values of terms and scores: ASCII characters that are no letter or digit part terms; A-Z are lower-cased.
SEPARATORS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() and b < 128 else 0x20 for b in range(128)) + bytes(range(128, 256))

_ROWS = "kind string, shard long, term string, n long, total long, data binary"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers in 7-bit groups, low ones first, all but the last marked; and where each ends."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        group = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - sizes)[has] + k] = group | np.where(sizes[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        has = starts + k <= ends
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << 7 * k
    return out


class _Shard:
    """Terms of documents as they come; rows() gives the shard's documents and postings."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.size = 0

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        number = self.number
        self.ids.append(np.fromiter((number.setdefault(t, len(number)) for t in found), np.int32, len(found)))
        self.doc_ids.append(doc_id)
        self.size += len(found)

    def rows(self, shard: int, batch: int = 50_000) -> Iterator[pa.RecordBatch]:
        none = np.array([x is None for x in self.doc_ids])
        ids = np.array([x or 0 for x in self.doc_ids], np.int64)
        order = np.lexsort((ids, none))  # null ids last
        lengths = np.array([len(x) for x in self.ids], np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs, tf = np.unique(np.concatenate(self.ids).astype(np.int64) * len(order) + np.repeat(place, lengths), return_counts=True)
        term, at = np.divmod(pairs, len(order))
        first = np.flatnonzero(np.diff(term, prepend=-1))
        gaps = np.diff(at, prepend=0)
        gaps[first] = at[first]
        data, ends = pack(np.column_stack((gaps, tf)).reshape(-1))
        ends = np.append(0, ends[1::2][np.append(first[1:], len(term)) - 1]).astype(np.int32) if len(term) else np.zeros(1, np.int32)
        df = np.diff(np.append(first, len(term)))
        own = ids[order].astype("<i8").tobytes() + lengths[order].astype("<i8").tobytes() + none[order].tobytes()
        yield _batch("documents", shard, pa.nulls(1, pa.string()), [int((lengths > 0).sum())], [self.size], pa.array([own], pa.large_binary()).cast(pa.binary()))
        names = list(self.number)
        for a in range(0, len(names), batch):
            b = min(a + batch, len(names))
            cut = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends[a : b + 1] - ends[a]), pa.py_buffer(data[ends[a] : ends[b]])])
            yield _batch("postings", shard, pa.array(names[a:b], pa.binary()).cast(pa.string()), df[a:b], np.zeros(b - a, np.int64), cut)


def _batch(kind: str, shard: int, term: pa.Array, n, total, data: pa.Array) -> pa.RecordBatch:
    many = len(term)
    return pa.RecordBatch.from_arrays([pa.array([kind] * many), pa.array([shard] * many, pa.int64()), term, pa.array(n, pa.int64()), pa.array(total, pa.int64()), data], names=["kind", "shard", "term", "n", "total", "data"])


def build(docs: DataFrame, folder: str, shard_terms: int = SHARD_TERMS) -> None:
    """Writes the index of docs (doc_id, text, and any other columns, which are ignored) to folder.

    Null and blank texts, and others without a term, are documents without postings. Rows with equal or null ids are documents
    of their own. A text of any length lies in one shard. An empty table gives an index without shards.
    """
    batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, open_shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in chunks(batches):
            for doc_id, text in zip(col(batch, "doc_id").to_pylist(), texts_of(batch)):
                open_shard.add(doc_id, terms(text))
                if open_shard.size >= shard_terms:
                    yield from open_shard.rows(shard)
                    shard, open_shard = shard + 1, _Shard()
        if open_shard.doc_ids:
            yield from open_shard.rows(shard)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _ROWS)
    found.write.partitionBy("kind").option("compression", "zstd").parquet(folder)


def query_terms(queries: DataFrame) -> DataFrame:
    """q, item_id, term, times: the terms of each different (item_id, text), with a number for it."""
    numbered = queries.select("item_id", F.col("text").cast("string").alias("text")).distinct().withColumn("q", F.monotonically_increasing_id())
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(SEPARATORS), F.lit(0))
    return numbered.select("q", "item_id", F.explode(found).alias("term")).groupBy("q", "item_id", "term").agg(F.count("*").alias("times"))


def merge(lists: list[tuple[list[int], list[int], int]], top: int) -> list[tuple[int, int]]:
    """score, place of the top documents with scores over 0, best first, of equal ones the first place; lists: places, scores, greatest score."""
    lists = sorted(lists, key=lambda x: x[2])
    n = len(lists)
    bound, total = [], 0  # what a list and all before it can give at most
    for _, _, most in lists:
        total += most
        bound.append(total)
    at = [0] * n
    lead, least = 0, 0  # lists from lead on are merged; a document needs more than least
    best: list[tuple[int, int]] = []
    heap = [places[0] * n + i for i, (places, _, _) in enumerate(lists)]
    heapq.heapify(heap)
    while heap:
        d = heap[0] // n
        score = 0
        while heap and heap[0] // n == d:
            i = heap[0] % n
            places, scores, _ = lists[i]
            k = at[i]
            score += scores[k]
            at[i] = k = k + 1
            if k < len(places):
                heapq.heapreplace(heap, places[k] * n + i)
            else:
                heapq.heappop(heap)
        for i in range(lead - 1, -1, -1):
            if score + bound[i] <= least:
                break
            places, scores, _ = lists[i]
            at[i] = k = bisect_left(places, d, at[i])
            if k < len(places) and places[k] == d:
                score += scores[k]
        if score <= least:
            continue
        if len(best) < top:
            heapq.heappush(best, (score, -d))
        else:
            heapq.heapreplace(best, (score, -d))
        if len(best) == top:
            least = best[0][0]
            if bound[lead] <= least:
                while lead < n and bound[lead] <= least:
                    lead += 1
                heap = [x for x in heap if x % n >= lead]
                heapq.heapify(heap)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def search(spark: SparkSession, folder: str, queries: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each query (item_id, text) the top documents with scores over 0, of equal ones the least doc_id.

    Queries without a term that some document has give no row; a query twice gives its rows once, and one item_id with two texts the
    rows of both. A null doc_id comes after all others. An empty index or an empty table of queries gives no row.
    """
    index = spark.read.schema(_ROWS).parquet(folder)
    n, total = index.where("kind = 'documents'").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    asked = Stored(query_terms(queries), "query-terms")
    wanted = asked.df.select("term").distinct()
    hits = Stored(index.where("kind = 'postings'").select("shard", "term", "n", "data").join(wanted, "term", "left_semi"), "query-postings")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.sum("n") + 1))).alias("w")
    weights = hits.df.groupBy("term").agg(weight)
    weighed = Stored(asked.df.join(weights, "term").select("q", "term", "w", "times"), "query-weights")
    blocks = max(1, -(-weighed.df.count() // block_terms))
    shards = index.where("kind = 'documents'").select("shard", "data")
    block_of = F.pmod(F.xxhash64("q"), F.lit(blocks))
    best = None
    for block in range(blocks):
        here = weighed.df.where(block_of == block)
        # block_terms rows, about
        asks = spark.sparkContext.broadcast(_by_query(here.collect()))
        own = hits.df.join(here.select("term").distinct(), "term", "left_semi") if blocks > 1 else hits.df
        found = shards.groupBy("shard").cogroup(own.select("shard", "term", "data").groupBy("shard")).applyInArrow(_searcher(asks, n, total, top), "q long, doc_id long, score long")
        best = found if best is None else best.union(found)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    items = asked.df.select("q", "item_id").distinct()
    out = Stored(ranked.join(items, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    for table in (asked, hits, weighed):
        table.drop()
    return out.df


def _by_query(rows: list) -> dict[int, list[tuple[str, int, int]]]:
    out: dict[int, list[tuple[str, int, int]]] = {}
    for r in rows:
        if r.w > 0:  # else it adds nothing to any score
            out.setdefault(r.q, []).append((r.term, r.w, r.times))
    return out


def _searcher(asks, n_docs: int, n_terms: int, top: int):
    def run(shard: pa.Table, postings: pa.Table) -> pa.Table:
        raw = shard.column("data")[0].as_buffer() if len(shard) else b""
        m = len(raw) // 17
        doc_ids, lengths, none = np.frombuffer(raw, "<i8", m), np.frombuffer(raw, "<i8", m, 8 * m), np.frombuffer(raw, bool, m, 16 * m)
        norm = 12 * (75 + 25 * lengths * n_docs // max(n_terms, 1))
        packed = dict(zip(postings.column("term").to_pylist(), postings.column("data").to_pylist()))
        lists: dict[str, tuple[list[int], np.ndarray]] = {}
        out: list[list[int]] = [[], [], []]
        for q, asked in asks.value.items():
            cursors = []
            for term, w, times in asked:
                if term not in packed:
                    continue
                if term not in lists:
                    values = unpack(np.frombuffer(packed[term], np.uint8))
                    at, tf = np.cumsum(values[::2]), values[1::2]
                    impact = w * (1_000_000_000 * tf // (1000 * tf + norm[at]))
                    lists[term] = (at.tolist(), impact.tolist(), int(impact.max()))
                at, impact, most = lists[term]
                cursors.append((at, impact, most) if times == 1 else (at, [times * x for x in impact], times * most))
            if cursors:
                for score, d in merge(cursors, top):
                    for column, value in zip(out, (q, d, score)):
                        column.append(value)
        d = np.array(out[1], np.int64)
        return pa.table({"q": pa.array(out[0], pa.int64()), "doc_id": pa.array(doc_ids[d], pa.int64(), mask=none[d]), "score": pa.array(out[2], pa.int64())})

    return run


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{SEPARATORS}')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{SEPARATORS}')) AS term FROM benchmark),
size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, n_docs),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folder_of(spark, f"index-{uuid.uuid4().hex}")
    build(documents(spark, sf_dir), folder)
    ranked = search(spark, folder, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    removed(spark, folder)
    return ranked
