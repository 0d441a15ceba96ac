"""Exact nearest cosines without comparing all with all: vectors in cells around pivots, and the triangle inequality for angles.

Equal vectors are one class with a number of rows. Each class lies in the cell of its nearest pivot, and of every cell the least
and greatest angle to each pivot are known. A vector cannot be nearer to anything in a cell than its own angles to the pivots
are to those ranges; cells that this keeps under tau, and under what the vector has found already, are not compared. Pivots decide
how much is compared and never what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .vectors import beside, parts_of

#: Pivots at most, and vectors from which they are taken; the driver and each task hold both, and a square table of angles.
PIVOTS, POOL = 256, 4096
#: Classes of a part of a cell. A task holds two parts and their products.
PART = 1024
#: What rounding may add to an angle or a cosine.
SLACK = 1e-6

_SIDE = "h1 long, h2 long, v array<double>, n long, cell int, lower double"


def _classes(rows: DataFrame, vector: str) -> DataFrame:
    """h1, h2 (128 bits of the vector), v, n: different vectors and their rows."""
    v = F.col(vector).cast("array<double>")
    return rows.select(F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2"), v.alias("v")).groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("n"))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def choose_pivots(pool: np.ndarray, count: int) -> np.ndarray:
    """Rows of pool, each as far as can be from those before it; fewer, where all others equal a pivot."""
    chosen = [0]
    near = pool @ pool[0]
    while len(chosen) < count:
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        chosen.append(far)
        near = np.maximum(near, pool @ pool[far])
    return pool[chosen]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _placed(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Classes with their cell, and lower: their greatest cosine with a pivot (a vector of the other side) that is not equal to it.

    Vectors of no length have the cell -1, and the cosine 0 with all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(2), batch.num_rows)
            if not batch.num_rows:
                continue
            s = _units(m) @ pivots.T
            none = np.linalg.norm(m, axis=1) < 1e-12
            cell = np.where(none, -1, s.argmax(axis=1))
            # a pivot within rounding of the vector may be the vector itself
            lower = np.where(s > 1 - 1e-9, -np.inf, s).max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(lower)], names=["h1", "h2", "v", "n", "cell", "lower"])

    return classes.select("h1", "h2", "v", "n").mapInArrow(run, _SIDE)


def _ranges(placed: DataFrame, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell and pivot the least and the greatest angle."""
    k = len(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            cell = batch.column(0).to_numpy()
            if len(cell):
                angle = _angles(_units(_matrix(batch.column(1), len(cell))), pivots)
                np.minimum.at(low, cell, angle)
                np.maximum.at(high, cell, angle)
        for c in np.flatnonzero(np.isfinite(low[:, 0])):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, c), pa.int32()), pa.array(np.arange(k), pa.int32()), pa.array(low[c]), pa.array(high[c])], names=["cell", "pivot", "low", "high"])

    low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    found = placed.where("cell >= 0").select("cell", "v").mapInArrow(run, "cell int, pivot int, low double, high double")
    for r in found.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # PIVOTS squared at most
        low[r.cell, r.pivot], high[r.cell, r.pivot] = r.low, r.high
    return low, high


def _part(parts: dict[int, int]):
    """The part of a class in its cell."""
    table = F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)) if parts else F.create_map(F.lit(0), F.lit(1))
    return F.pmod(F.col("h1"), F.coalesce(F.get(F.array(F.try_element_at(table, F.col("cell"))), F.lit(0)), F.lit(1)))


def _parts(placed: DataFrame) -> dict[int, int]:
    return {r.cell: -(-r.n // PART) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # PIVOTS + 1 rows


def _compared(left: DataFrame, right: DataFrame, tau: float) -> DataFrame:
    """h1, h2, best, over, compared of the left classes, from groups (i, p, j, q) that both sides have."""

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        n, m = len(a), len(b)
        if not n or not m:
            return pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "best": pa.array([], pa.float64()), "over": pa.array([], pa.int64()), "compared": pa.array([], pa.int64())})
        s = _units(_matrix(a.column("v"), n)) @ _units(_matrix(b.column("v"), m)).T
        same = (a.column("h1").to_numpy()[:, None] == b.column("h1").to_numpy()) & (a.column("h2").to_numpy()[:, None] == b.column("h2").to_numpy())
        s[same] = -np.inf
        over = (s > tau) @ b.column("n").to_numpy()
        return pa.table({"h1": a.column("h1"), "h2": a.column("h2"), "best": s.max(axis=1), "over": over.astype(np.int64), "compared": np.full(n, m, np.int64)})

    keys = ("i", "p", "j", "q")
    # new columns, as both sides may come from one table
    left, right = (d.select(*(F.col(c).alias(c) for c in ("h1", "h2", "v", *more, *keys))) for d, more in ((left, ()), (right, ("n",))))
    groups = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return groups.applyInArrow(compare, "h1 long, h2 long, best double, over long, compared long")


def nearest(a: DataFrame, b: DataFrame, key: str, vector: str, tau: float, pivots: int = PIVOTS) -> DataFrame:
    """For every key of a: its greatest cosine with another key of b (-inf without one), how many are over tau, and with how many
    different vectors of b its own was compared.

    Keys are those of rows: unique on each side, and a key on both sides has the same vector there. Equal vectors are compared once,
    however many there are; a cell of any size is cut into parts. Vectors of no length have the cosine 0 with all. Null vectors do not count.
    """
    spark = a.sparkSession
    a, b = (d.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null") for d in (a, b))
    of_a, of_b = checkpointed(_classes(a, "v")), checkpointed(_classes(b, "v"))
    pool = of_b.where(F.exists("v", lambda x: F.abs(x) > 1e-12)).orderBy("h1", "h2").limit(POOL).select("v").collect()  # by hash: in no order
    if not pool:
        return _finish(a, b, of_b, spark.createDataFrame([], "h1 long, h2 long, best double, over long, compared long"), tau)
    # cells are about as many as vectors in one of them, up to the bound
    centres = choose_pivots(_units(np.array([r.v for r in pool], np.float64)), min(pivots, 1 + int(of_b.count() ** 0.5 / 2)))
    left, right = checkpointed(_placed(of_a, centres)), checkpointed(_placed(of_b, centres))
    low, high = _ranges(right, centres)
    parts_a, parts_b = _parts(left), _parts(right)
    left, right = left.withColumn("part", _part(parts_a)), right.withColumn("part", _part(parts_b))
    # first each class and one part of its own cell on the other side, so that it knows something near
    at = lambda d, i, p, j, q: d.withColumns({"i": i, "p": p, "j": j, "q": q})
    cell, part = F.col("cell"), F.col("part")
    parts_there = F.create_map(*(F.lit(x) for c in set(parts_a) | set(parts_b) for x in (c, max(1, parts_b.get(c, 0)))))
    twin = F.pmod(part, F.try_element_at(parts_there, cell))
    shares = left.select("cell", "part").distinct().withColumn("q", F.pmod(part, F.try_element_at(parts_there, cell)))
    own = right.join(shares.select(F.col("cell").alias("there"), F.col("part").alias("p"), "q"), (cell == F.col("there")) & (part == F.col("q")))
    near = checkpointed(_compared(at(left, cell, part, cell, twin), at(own, cell, F.col("p"), cell, F.col("q")), tau))
    first = left.join(near.select("h1", "h2", "best", F.col("compared").alias("done")), ["h1", "h2"], "left")
    # then the cells that may hold something nearer, or over tau
    first = first.withColumn("lower", F.greatest("lower", F.coalesce("best", F.lit(float("-inf"))))).select("h1", "h2", "v", F.lit(1).cast("long").alias("n"), "cell", "part", "lower")
    # what the first step has compared is not compared again
    asks = _packed(_wanted(first, centres, low, high, sorted(parts_b), tau), parts_a).withColumn("twin", F.pmod("part", F.try_element_at(parts_there, cell)))
    there = _packed(right.withColumn("cells", F.lit(b"")), parts_b).drop("asked")
    again = (F.col("a_cell") == F.col("b_cell")) & (F.col("b_part") == F.col("a_twin"))
    blocks = beside(asks, there, F.array_contains("a_asked", F.col("b_cell")) & ~again)
    found = near.union(_asked(blocks, tau))
    total = found.groupBy("h1", "h2").agg(F.max("best").alias("best"), F.sum("over").alias("over"), F.sum("compared").alias("compared"))
    # a pivot that was near is a vector of b, so its cosine counts even where its cell was not compared
    total = left.select("h1", "h2", "lower").join(total, ["h1", "h2"], "left").select("h1", "h2", F.greatest("lower", F.coalesce("best", F.lit(float("-inf")))).alias("best"), F.coalesce("over", F.lit(0)).alias("over"), F.coalesce("compared", F.lit(0)).alias("compared"))
    return _finish(a, b, of_b, total, tau)


def _wanted(rows: DataFrame, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, there: list[int], tau: float) -> DataFrame:
    """rows with cells, a bit for each cell from -1 on: those of there whose greatest possible cosine is over tau, or over the row's lower."""
    cells = np.array([c for c in there if c >= 0], np.int64)
    empty = -1 in there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            m = _matrix(batch.column(2), n)
            none = np.linalg.norm(m, axis=1) < 1e-12
            angle = _angles(_units(m), pivots)
            lower = batch.column(6).to_numpy()
            least = np.zeros((n, len(cells)))
            for p in range(len(pivots)):
                np.maximum(least, np.maximum(angle[:, p : p + 1] - high[cells, p], low[cells, p] - angle[:, p : p + 1]), out=least)
            most = np.where(none[:, None], 0.0, np.minimum(np.cos(np.clip(least - SLACK, 0, np.pi)) + 1e-12, 1.0))
            ask = np.zeros((n, len(pivots) + 1), np.bool_)
            ask[:, cells + 1] = (most > lower[:, None]) | (most > tau)
            ask[:, 0] = empty & ((0 > lower) | (0 > tau))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([x.tobytes() for x in np.packbits(ask, axis=1)], pa.binary())], names=[*batch.schema.names[:6], "cells"])

    return rows.mapInArrow(run, "h1 long, h2 long, v array<double>, n long, cell int, part long, cells binary")


_PARTS = "cell int, part long, keys binary, v binary, bits binary, asked array<int>"


def _packed(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    """A row for each part of a cell: h1, h2 and n of its classes and their unit vectors as the bytes of numbers, the bits of the
    cells that each class asks for, and the cells that any of them does. Stored, in parts whose number depends on the cores."""

    def pack(t: pa.Table) -> pa.Table:
        keys = np.stack([t.column(c).to_numpy() for c in ("h1", "h2", "n")])
        bits = t.column("cells").to_pylist()
        asked = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(np.frombuffer(b"".join(bits), np.uint8).reshape(len(t), -1), axis=0))) - 1 if bits[0] else []
        v = _units(_matrix(t.column("v"), len(t)))
        values = ([keys.tobytes()], [v.tobytes()], [b"".join(bits)])
        return pa.table({"cell": t.column("cell")[:1], "part": t.column("part")[:1], **{k: pa.array(x, pa.binary()) for k, x in zip(("keys", "v", "bits"), values)}, "asked": pa.array([asked], pa.list_(pa.int32()))})

    rows = rows.select("h1", "h2", "v", "n", "cell", "part", "cells").repartition(parts_of(rows, sum(parts.values())), "cell", "part")
    return checkpointed(rows.groupBy("cell", "part").applyInArrow(pack, _PARTS))


def _asked(blocks: DataFrame, tau: float) -> DataFrame:
    """h1, h2, best, over, compared of classes of a_ that ask for the cell of b_ beside them; a class has a row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}  # of a share of the parts

        for batch in batches:
            for r in range(batch.num_rows):
                at = {c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}
                (a, x), (b, y) = ((lambda k, v: (k, v.reshape(k.shape[1], -1)))(np.frombuffer(at[f"{s}_keys"].as_buffer(), np.int64).reshape(3, -1), np.frombuffer(at[f"{s}_v"].as_buffer(), np.float64)) for s in "ab")
                bits = np.frombuffer(at["a_bits"].as_buffer(), np.uint8).reshape(a.shape[1], -1)
                place = at["b_cell"].as_py() + 1
                rows = np.flatnonzero(bits[:, place >> 3] >> (7 - (place & 7)) & 1)
                s = x[rows] @ y.T
                if np.intersect1d(a[0, rows], b[0]).size:
                    s[(a[0, rows][:, None] == b[0]) & (a[1, rows][:, None] == b[1])] = -np.inf
                key = (at["a_cell"].as_py(), at["a_part"].as_py())
                if key not in found:
                    found[key] = [a[0], a[1], np.full(a.shape[1], -np.inf), np.zeros(a.shape[1], np.int64), np.zeros(a.shape[1], np.int64)]
                _, _, best, over, compared = found[key]
                best[rows] = np.maximum(best[rows], s.max(axis=1))
                over[rows] += ((s > tau) @ b[2]).astype(np.int64)
                compared[rows] += len(y)
        for columns in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "best", "over", "compared"])

    return blocks.select("a_cell", "a_part", "a_keys", "a_v", "a_bits", "b_cell", "b_keys", "b_v").mapInArrow(run, "h1 long, h2 long, best double, over long, compared long")


def _finish(a: DataFrame, b: DataFrame, of_b: DataFrame, found: DataFrame, tau: float) -> DataFrame:
    """Results of classes for the keys of a, with the other rows of their own class: cosine 1, or 0 without length."""
    mine = a.join(b.select("key", F.lit(1).alias("own")), "key", "left").select("key", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"), F.coalesce("own", F.lit(0)).alias("own"), F.when(F.exists("v", lambda x: F.abs(x) > 1e-12), 1.0).otherwise(0.0).alias("itself"))
    rows = mine.join(of_b.select("h1", "h2", "n"), ["h1", "h2"], "left").join(found, ["h1", "h2"], "left")
    copies = F.coalesce("n", F.lit(0)) - F.col("own")
    best = F.greatest(F.coalesce("best", F.lit(float("-inf"))), F.when(copies > 0, F.col("itself")))
    over = F.coalesce("over", F.lit(0)) + F.when((copies > 0) & (F.col("itself") > tau), copies).otherwise(0)
    return rows.select("key", best.alias("best"), over.cast("bigint").alias("over"), F.coalesce("compared", F.lit(0)).alias("compared"))
