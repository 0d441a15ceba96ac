"""Permutation test of the squared maximum mean discrepancy over all rows, block against block.

Rows are numbered and cut in blocks. For each pair of blocks, their part of the kernel is multiplied by the marks of all permutations
at once, and only sums leave the task. Which rows a permutation marks follows from seed, numbers of rows and a block's number:
every task draws its own blocks' share by halving, so no permutation is stored or sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .order import with_index
from .vectors import beside, packed, unpacked

#: Rows of a block. A task holds two of them, their kernel and the marks of all permutations in them.
BLOCK = 1024
#: Rows of each side, by a hash of the key, whose median distance sets the kernel's width where none is given.
WIDTH_ROWS = 1000

RESULT = "mmd2 double, p_value double, n_a long, n_b long, gamma double, status string"


def marks(block: int, n: int, m: int, permutations: int, seed: int, size: int = BLOCK) -> np.ndarray:
    """Rows of a block by permutations: which are among the m that each permutation takes out of n, all choices as likely as others."""
    low, high = 0, -(-n // size)
    ones = np.full(permutations, m)
    while high - low > 1:
        mid = (low + high) // 2
        here, left = min(n, high * size) - low * size, (mid - low) * size
        taken = np.random.default_rng([seed, low, high]).hypergeometric(ones, here - ones, left) if left < here else ones
        low, high, ones = (low, mid, taken) if block < mid else (mid, high, ones - taken)
    rows = min(n, high * size) - low * size
    order = np.random.default_rng([seed, low, low]).random((rows, permutations)).argsort(axis=0).argsort(axis=0)
    return (order < ones).astype(np.float64)


def statistic(own: np.ndarray, reach: np.ndarray, total: float, m: int, k: int) -> np.ndarray:
    """Unbiased squared discrepancies: own, the kernel's sum within the m marked rows; reach, from them to all; total, over all."""
    cross = reach - own
    rest = total - 2 * reach + own
    # the diagonal, where the kernel is 1, does not count
    return (own - m) / (m * (m - 1)) + (rest - k) / (k * (k - 1)) - 2 * cross / (m * k)


def median_gamma(a: DataFrame, b: DataFrame, vector: str, key: str, seed: int = 0, rows: int = WIDTH_ROWS) -> float:
    """1 over the median squared distance above 0 among some rows of both sides; one task holds them."""

    def run(batches):
        z = [batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for batch in batches if batch.num_rows]
        if z:
            z = np.vstack(z)
            square = (z * z).sum(axis=1)
            d2 = square[:, None] + square[None, :] - 2 * z @ z.T
            d2 = d2[np.triu_indices(len(z), 1)]
            d2 = d2[d2 > 1e-12]
            yield pa.RecordBatch.from_arrays([pa.array([1 / float(np.median(d2)) if len(d2) else 1.0])], names=["gamma"])

    some = None
    for d in (a, b):
        d = d.orderBy(F.xxhash64(F.lit(seed), key), key).limit(rows).select(F.col(vector).cast("array<double>").alias("v"))
        some = d if some is None else some.union(d)
    return some.repartition(1).mapInArrow(run, "gamma double").first().gamma


def permutation_test(a: DataFrame, b: DataFrame, vector: str, key: str, permutations: int = 200, min_rows: int = 50, seed: int = 0, gamma: float | None = None) -> DataFrame:
    """One row: unbiased squared discrepancy of all rows of both sides under a Gaussian kernel, the share of permutations (and the
    sides themselves) with as great a one, rows, gamma, and status: unavailable with fewer than min_rows on a side.

    Null vectors do not count. Work grows with the square of the rows, as the statistic does; what is shuffled are vectors, a few
    times each, and 2 * permutations sums for each task.
    """
    spark = a.sparkSession
    a, b = a.where(F.col(vector).isNotNull()), b.where(F.col(vector).isNotNull())
    m, k = a.count(), b.count()
    if m < max(min_rows, 2) or k < max(min_rows, 2):
        return spark.createDataFrame([(None, None, m, k, None, "unavailable")], RESULT)
    gamma = median_gamma(a, b, vector, key, seed) if gamma is None else gamma
    n, size = m + k, BLOCK
    side = lambda d, first: d.select(F.col(key).alias("key"), F.lit(first).alias("first"), F.col(vector).cast("array<double>").alias("v"))
    rows = with_index(side(a, True).union(side(b, False)), [F.xxhash64("key"), "first"], "i")
    rows = checkpointed(rows.select(F.expr(f"cast(i div {size} as int)").alias("block"), F.pmod("i", F.lit(size)).alias("at"), "first", "v"))
    blocks = -(-n // size)
    packs = packed(rows.select("block", (2 * F.col("at") + F.col("first").cast("long")).alias("key"), "v"), blocks)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}  # marks of a share of the blocks, a byte each

        def part(batch: pa.RecordBatch, r: int, side: str) -> tuple[int, np.ndarray, np.ndarray]:
            block, keys, v = (batch.column(batch.schema.get_field_index(f"{side}_{c}"))[r] for c in ("block", "keys", "v"))
            keys, v = unpacked(keys.as_buffer(), v.as_buffer())
            block = block.as_py()
            if block not in drawn:
                drawn[block] = np.column_stack((keys % 2, marks(block, n, m, permutations, seed, size))).astype(np.bool_)
            return block, v, drawn[block].astype(np.float64)

        found = np.zeros(2 * permutations + 3)
        for batch in batches:
            for r in range(batch.num_rows):
                (p, u, in_p), (q, w, in_q) = part(batch, r, "a"), part(batch, r, "b")
                d2 = (u * u).sum(axis=1)[:, None] + (w * w).sum(axis=1)[None, :] - 2 * u @ w.T
                kernel = np.exp(-gamma * np.maximum(d2, 0))
                if p == q:
                    np.fill_diagonal(kernel, 1)
                own = (in_p * (kernel @ in_q)).sum(axis=0)
                reach, total = in_p.T @ kernel.sum(axis=1), kernel.sum()
                if p != q:
                    own, reach, total = 2 * own, reach + in_q.T @ kernel.sum(axis=0), 2 * total
                found += np.concatenate((own, reach, [total]))
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.float64()))], names=["sums"])

    found = beside(packs, packs, F.col("a_block") <= F.col("b_block")).select("a_block", "a_keys", "a_v", "b_block", "b_keys", "b_v").mapInArrow(sums, "sums array<double>")
    total = np.array([r.x for r in found.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])
    own, reach = total[: permutations + 1], total[permutations + 1 : -1]
    seen = statistic(own, reach, total[-1], m, k)
    p = float((1 + (seen[1:] >= seen[0]).sum()) / (1 + permutations))
    return spark.createDataFrame([(float(seen[0]), p, m, k, float(gamma), "ok")], RESULT)
