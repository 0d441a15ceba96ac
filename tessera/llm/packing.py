"""Best-fit packing of token sequences, bulk-synchronous.

Every document becomes pieces of at most `capacity` tokens. Pieces that are not placed yet and the gaps of open sequences
are two tables. A superstep sorts both by descending size into ranges, a gap before a piece of its size, and sweeps:

1. Each task places the pieces of its range, longest first, into the smallest gaps of its range that are large enough.
2. Pieces for which a range has no gap look for a successor in the ranges above. What these have left to offer is known
   by numbers and bounds for each range, so ranks decide all conflicts: the pieces of a range, in order, take the gaps of
   the nearest range above that has some, the smallest first, as many pieces a gap as surely fit.
3. Gaps that were used shrink, or are full.

Pieces longer than every gap that is left need new sequences: as many as their tokens fill are offered to the next
superstep as gaps of the whole capacity, which the sweep takes last. That repeats till every piece has its place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe_ids
from .common import Stored, batch_rows, chunks, col, documents, partitions, texts_of

CAPACITY = 1024
END_ID = 2
#: Rows of a range, where the session's number of partitions allows; ranges become larger beyond that.
RANGE_ROWS = 50_000
_PIECE = "pid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_SWEPT = "part int, gap boolean, id long, size long, rank long, seq long, offset long, n long"


def sweep(gaps: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of lengths into gaps, both in descending order.

    Returns for each length the gap that it goes to (-1 for none) and how much of that gap is used before it, and what is
    left of each gap. Runs of equal gaps and of equal lengths are placed at once: a run of n gaps takes as many of the
    lengths, one gap after another, as each can hold.
    """
    into, used, left = np.full(len(lengths), -1), np.zeros(len(lengths), np.int64), gaps.astype(np.int64)
    runs: dict[int, list[tuple[int, int]]] = {}  # size -> (first gap, number) of runs of gaps that have it now
    sizes: list[int] = []  # in ascending order

    def put(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in runs:
                runs[size] = []
                insort(sizes, size)
            runs[size].append((first, n))

    def edges(x: np.ndarray) -> list[int]:
        return [*np.flatnonzero(np.r_[True, x[1:] != x[:-1]]).tolist(), len(x)] if len(x) else [0]

    at = edges(gaps)
    for a, b in zip(at, at[1:]):
        put(int(gaps[a]), a, b - a)
    at = edges(lengths)
    for a, b in zip(at, at[1:]):
        length = int(lengths[a])
        while a < b and (k := bisect_left(sizes, length)) < len(sizes):
            size = sizes[k]
            first, n = runs[size].pop()
            if not runs[size]:
                del runs[size], sizes[k]
            each = size // length
            whole = min(n, (b - a) // each)  # gaps that are filled
            rest = min(b - a - whole * each, each) if whole < n else 0  # lengths in one more
            took = np.arange(whole * each + rest)
            into[a : a + len(took)] = first + took // each
            used[a : a + len(took)] = (gaps[first + took // each] - size) + took % each * length
            left[first : first + whole] = size - each * length
            put(size - each * length, first, whole)
            if rest:
                left[first + whole] = size - rest * length
                put(size - rest * length, first + whole, 1)
            put(size, first + whole + (rest > 0), n - whole - (rest > 0))
            a += len(took)
    return into, used, left


def successors(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, bool, int, int, int, int, int]]:
    """Which pieces that their range has no gap for go to which gaps of ranges above.

    ranges: (range, pieces without a gap, the longest of them, gaps on offer, the smallest of them), from the top. Returns
    (range, whether of gaps, first rank, end rank, base, step, each): a rank r of those has the match base + step * ((r -
    first) // each). A match is one gap and the pieces that go there. There are at most four rows a range.
    """
    out, stack, base = [], [], 0
    for part, n, longest, offered, smallest in ranges:
        first = 0
        while n and stack:
            above, m, size = stack.pop()
            each = size // longest
            some = min(m, -(-n // each))
            took = min(n, some * each)
            out.append((part, False, first, first + took, base, 1, each))
            out.append((above, True, m - some, m, base + some - 1, -1, 1))
            first, n, base = first + took, n - took, base + some
            if m > some:
                stack.append((above, m - some, size))
        if offered:
            stack.append((part, offered, smallest))
    return out


def _superstep(items: DataFrame, parts: int, capacity: int) -> DataFrame:
    """Items (gap or piece, id, size) range-sorted and swept within their range.

    Placed pieces have seq and offset. Of pieces without a gap, and of gaps on offer to the ranges below (those that are
    still as large as these may need), rank is the place in the order of their range. Each range adds a summary: rows with
    n, the number of these of one size (rank 0), and of gaps of one size that are not on offer (rank null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        is_gap, ids, sizes = (table.column(c).to_numpy(zero_copy_only=False) for c in ("gap", "id", "size"))
        gap, piece = np.flatnonzero(is_gap), np.flatnonzero(~is_gap)
        into, used, left = sweep(sizes[gap], sizes[piece])
        found = into >= 0
        seq, offset = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        if found.any():
            to = gap[into[found]]
            seq[piece[found]], offset[piece[found]] = ids[to], capacity - sizes[to] + used[found]
        rank = np.full(len(ids), -1)
        rank[piece[~found]] = np.arange(len(piece) - found.sum())
        order = np.argsort(-left, kind="stable")
        order = order[left[order] >= sizes[-1]]
        rank[gap[order]] = np.arange(len(order))
        now = sizes.copy()
        now[gap] = left
        waiting = (seq < 0) & (is_gap <= (now > 0))  # a gap of nothing is none
        tallies = []
        for kind, offered in ((False, True), (True, True), (True, False)):
            found, n = np.unique(now[waiting & (is_gap == kind) & ((rank >= 0) == offered)], return_counts=True)
            tallies += [(kind, 0 if offered else -1, x, m) for x, m in zip(found[::-1], n[::-1])]
        kinds, ranks, values, numbers = (np.array(x) for x in zip(*tallies)) if tallies else (np.zeros(0, np.int64),) * 4
        keep = np.flatnonzero(waiting | (seq >= 0))
        none, m = np.full(len(numbers), -1), len(keep)
        rank, seq = np.r_[rank[keep], ranks], np.r_[seq[keep], none]
        number = np.r_[np.full(m, -1), numbers]
        whole = [(np.full(m + len(none), TaskContext.get().partitionId()), pa.int32(), None), (np.r_[is_gap[keep], kinds.astype(bool)], pa.bool_(), None), (np.r_[ids[keep], none], pa.int64(), None)]
        whole += [(np.r_[now[keep], values], pa.int64(), None), (rank, pa.int64(), rank < 0), (seq, pa.int64(), seq < 0), (np.r_[offset[keep], none], pa.int64(), seq < 0), (number, pa.int64(), number < 0)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t, mask=mask) for x, t, mask in whole], names=["part", "gap", "id", "size", "rank", "seq", "offset", "n"])

    keys = [F.col("size").desc(), F.col("gap").desc(), F.col("id")]
    return items.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, _SWEPT)


def _bounds(tallies: list[Row]) -> list[tuple[int, int, int, int, int]]:
    """What successors() needs of each range."""
    ranges: dict[int, list[int]] = {}
    for r in tallies:
        own = ranges.setdefault(r.part, [0, 0, 0, 1 << 62])
        if r.rank is not None:
            own[2 if r.gap else 0] += r.n
            if r.gap:
                own[3] = min(own[3], r.size)
            else:
                own[1] = max(own[1], r.size)
    return [(p, *own) for p, own in sorted(ranges.items())]


def _left(tallies: list[Row], found: list[tuple]) -> tuple[dict[int, int], int]:
    """How many pieces of each length the matches found leave without a place, and the largest gap that no match has."""
    took: dict[tuple[int, bool], list[tuple[int, int]]] = {}
    for part, of_gaps, first, end, *_ in found:
        took.setdefault((part, of_gaps), []).append((first, end))
    lengths: dict[int, int] = {}
    largest, at = 0, dict.fromkeys(took, 0)
    for r in sorted(tallies, key=lambda r: (r.part, -r.size)):
        n = r.n
        if r.rank is not None and (key := (r.part, r.gap)) in took:  # ranks begin, at the greatest size, with 0
            a, b = at[key], at[key] + r.n
            n -= sum(max(0, min(b, end) - max(a, first)) for first, end in took[key])
            at[key] = b
        if n and r.gap:
            largest = max(largest, r.size)
        elif n:
            lengths[r.size] = lengths.get(r.size, 0) + n
    return lengths, largest


def place(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> Stored:
    """pid, seq, offset of all pieces (pid, length: 1 to capacity). Ties go by pid; an empty table gives an empty one.

    The driver sees numbers by length and by range, at most twice as many rows as there are lengths and ranges, and the rows
    of successors(); gaps and pieces stay in tables.
    """
    spark = pieces.sparkSession
    lengths = dict(pieces.groupBy("length").agg(F.count("*")).collect())  # a row for each length
    open_, gaps, placed, before = pieces.select(F.lit(False).alias("gap"), F.col("pid").alias("id"), F.col("length").cast("long").alias("size")), None, [], []
    opened = largest = 0
    while lengths:
        n, items = sum(lengths.values()), open_
        if gaps is not None and largest >= min(lengths):
            items = items.union(gaps.where(F.col("size") >= min(lengths)))
        alone = {k: v for k, v in lengths.items() if k > largest}
        if alone:  # longer than every gap: their tokens fill so many sequences at least, and so many of them fit in one at most
            fresh = max(-(-sum(k * v for k, v in alone.items()) // capacity), -(-sum(alone.values()) // (capacity // min(alone))))
            items = items.union(spark.range(opened, opened + fresh).select(F.lit(True), "id", F.lit(capacity).cast("long")))
            opened += fresh
        swept = Stored(_superstep(items, max(1, min(partitions(spark), n // range_rows)), capacity), "swept")
        tallies = swept.df.where("n is not null").select("part", "gap", "size", "rank", "n").collect()
        found = successors(_bounds(tallies))
        lengths, largest = _left(tallies, found)
        rows = swept.df.where("n is null and seq is null")
        if found:
            to = F.broadcast(spark.createDataFrame(found, "p int, g boolean, first long, end long, base long, step int, each long"))
            rows = rows.join(to, (F.col("part") == F.col("p")) & (F.col("gap") == F.col("g")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")), "left")
            rows = rows.select("gap", "id", "size", "rank", (F.col("base") + F.col("step") * F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("match"))
            taken = rows.where("gap and match is not null").select("match", F.col("id").alias("seq"), F.col("size").alias("room"))
            going = rows.where("not gap and match is not null").select("match", F.col("id").alias("pid"), F.col("size").alias("length"), "rank")
            within = Window.partitionBy("match").orderBy("rank")  # at most capacity pieces
            used = F.sum("length").over(within)
            matched = going.join(taken, "match").select("pid", "seq", (F.lit(capacity) - F.col("room") + used - F.col("length")).alias("offset"), (F.col("room") - used).alias("rest"), F.lead("pid").over(within).isNull().alias("last"))
            across = Stored(matched, "across")
            placed.append(across.df.select("pid", "seq", "offset"))
            before.append(across)
            rows = rows.where("match is null")
        placed.append(swept.df.where("seq is not null").select(F.col("id").alias("pid"), "seq", "offset"))
        before.append(swept)
        open_, gaps = rows.where("not gap").select("gap", "id", "size"), rows.where("gap").select("gap", "id", "size")
        if found:
            shrunk = across.df.where("last and rest > 0")
            gaps = gaps.union(shrunk.select(F.lit(True), F.col("seq").alias("id"), F.col("rest").alias("size")))
            largest = max(largest, shrunk.agg(F.coalesce(F.max("rest"), F.lit(0))).first()[0])
    none = spark.createDataFrame([], "pid long, seq long, offset long")
    for x in placed:
        none = none.union(x)
    out = Stored(none, "placed")
    for s in before:
        s.drop()
    return out


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document: capacity tokens each, but the first, which has the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid = bpe_ids.encoder(path, pattern), TaskContext.get().partitionId() << 40
        for batch in chunks(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(col(batch, "doc_id").to_pylist(), texts_of(batch)):
                ids = bpe_ids.encode(enc, text, end_id)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = [pa.array(np.arange(pid, pid + len(rows))), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["pid", "doc_id", "piece", "start", "length", "ids_crc32"])
            pid += len(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECE)


def pack(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Packs docs (doc_id, text; other columns are ignored) and returns their pieces with sequence_id and offset.

    Null and empty texts have only the end id; an empty table gives no rows; rows with equal ids are packed each. Texts of
    any length are cut into as many pieces as they need.
    """
    batch_rows(docs.sparkSession)
    stored = Stored(pieces(docs, path, pattern, end_id, capacity), "pieces").df
    placed = place(stored, capacity).df
    return stored.join(placed, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
