"""Context-triggered piecewise hashes of whole texts, and their likeness.

A rolling hash over WINDOW bytes of UTF-8 ends a chunk wherever its low k bits are zero: chunks of 2**k bytes on average,
cut by content, so that an edit changes the chunks near it alone. Each chunk gives one character of the signature, which
has SIGNATURE characters at most (the last one stands for all the rest). A fingerprint is `k:signature:signature at k+1`.
Two fingerprints are compatible if they share a k; their likeness is 1 - edit distance / length of the longer signature
at that k, provided the signatures have a run in common, and else 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, _powers, batch_rows, chunks, col, documents, mix64, partitions, texts_of

WINDOW = 7
SIGNATURE = 64
#: Chunks are of 4 bytes on average at least; a smaller k is tried while a signature has fewer than half its characters.
LEAST_K = 2
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CODE = np.zeros(256, np.uint8)
_CODE[_ALPHABET] = np.arange(64)
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(texts: list[bytes]) -> list[str]:
    """The empty text has empty signatures."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    zeros = np.zeros(len(data), np.uint8)  # low zero bits of the rolling hash of the window that ends there
    if len(data) >= WINDOW:
        rolling = mix64((prefix[WINDOW:] - prefix[:-WINDOW]) * down[: len(prefix) - WINDOW])
        zeros[WINDOW - 1 :] = np.bitwise_count((rolling & (~rolling + np.uint64(1))) - np.uint64(1))
    spans: list[np.ndarray] = []
    ks: list[int] = []
    begin = 0
    for n in sizes.tolist():
        own = zeros[begin : begin + n]
        k = max(LEAST_K, (max(n, 1) - 1).bit_length() - 6)
        at = np.flatnonzero(own >= k)
        at = at[at >= WINDOW - 1]
        while k > LEAST_K and len(at) < SIGNATURE // 2:
            k -= 1
            at = np.flatnonzero(own >= k)
            at = at[at >= WINDOW - 1]
        for cut in (at, at[own[at] > k]):
            cut = cut[: SIGNATURE - 1] + 1
            ends = cut if n and len(cut) and cut[-1] == n else np.append(cut, n) if n else cut[:0]
            spans.append(ends + begin)
        ks.append(k)
        begin += n
    starts_of = np.repeat(np.cumsum(sizes) - sizes, 2)
    lengths = np.array([len(x) for x in spans], np.int64)
    ends = np.concatenate(spans).astype(np.int64) if spans else np.zeros(0, np.int64)
    starts = np.concatenate([ends[:0], np.append(0, ends[:-1])]) if len(ends) else ends
    firsts = (np.cumsum(lengths) - lengths)[lengths > 0]
    starts[firsts] = starts_of[lengths > 0]
    hashes = mix64((prefix[ends] - prefix[starts]) * down[starts])
    chars = _ALPHABET[hashes >> np.uint64(58)].tobytes().decode()
    out, at = [], 0
    for k, a, b in zip(ks, lengths[::2].tolist(), lengths[1::2].tolist()):
        out.append(f"{k}:{chars[at : at + a]}:{chars[at + a : at + a + b]}")
        at += a + b
    return out


def _matrix(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in strings], np.int64)
    raw = np.frombuffer("".join(s.ljust(SIGNATURE, "A") for s in strings).encode(), np.uint8)
    return _CODE[raw].reshape(len(strings), SIGNATURE), lengths


def signature_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of all pairs (left[i], right[i]) side by side, one bit a character of left."""
    if not left:
        return np.zeros(0)
    a, m = _matrix(left)
    b, n = _matrix(right)
    one = np.uint64(1)
    rows = np.arange(len(left))
    where = np.zeros((len(left), 64), np.uint64)  # positions in left of each character
    for i in range(SIGNATURE):
        here = rows[m > i]
        where[here, a[here, i]] |= one << np.uint64(i)
    plus, minus = np.full(len(left), ~np.uint64(0)), np.zeros(len(left), np.uint64)
    score = m.copy()
    top = np.maximum(m - 1, 0).astype(np.uint64)
    need = np.minimum(WINDOW, np.maximum(1, np.minimum(m, n) // 4))
    runs = np.zeros((WINDOW, len(left)), np.uint64)  # runs[g]: ends in left of common runs of g + 1 characters that end here
    common = np.zeros(len(left), bool)
    for j in range(int(n.max())):
        live = n > j
        eq = np.where(live, where[rows, b[:, j]], np.uint64(0))
        runs[1:] = (runs[:-1] << one) & eq
        runs[0] = eq
        common |= (runs[need - 1, rows] != 0) & live
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, dn = minus | ~(horizontal | plus), plus & horizontal
        change = ((up >> top) & one).astype(np.int64) - ((dn >> top) & one).astype(np.int64)
        score += np.where(live, change, 0)
        up, dn = (up << one) | one, dn << one
        plus, minus = dn | ~(vertical | up), up & vertical
    score = np.where(m == 0, n, score)
    longest = np.maximum(m, n)
    return np.where(longest == 0, 1.0, np.where(common, 1 - score / np.maximum(longest, 1), 0.0))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; 1 for equal ones, 0 where no block size is shared."""
    out = np.array([float(x == y) for x, y in zip(left, right)])
    pairs: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(left, right)):
        if x != y:
            (k, x1, x2), (j, y1, y2) = x.split(":"), y.split(":")
            k, j = int(k), int(j)
            if k == j:
                pairs += [(i, x1, y1), (i, x2, y2)]
            elif k == j + 1:
                pairs.append((i, x1, y2))
            elif j == k + 1:
                pairs.append((i, x2, y1))
    if pairs:
        index, a, b = zip(*pairs)
        np.maximum.at(out, np.array(index), signature_likeness(list(a), list(b)))
    return out


def _with_next(rows: Iterable[tuple[int, bool, int | None, str]]) -> Iterator[tuple[int | None, str, str]]:
    """(doc_id, text, text of the next row) of rows (bucket, whether it only follows, doc_id, text) in order."""
    held = None
    for bucket, follows, doc_id, text in rows:
        if held and held[0] == bucket:
            yield held[1], held[2], text
            held = None
        if not follows:
            held = (bucket, doc_id, text)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness, as the contract of op6 has them.

    The next document is the one with the next lower doc_id, and after the last the first; null ids come last; rows with
    equal ids follow each other by a hash of the text. Null texts are empty. One row follows itself; an empty table gives
    no rows. Other columns are ignored. Documents go to buckets of doc_id ranges, which are read in order; the first
    document of each bucket is also sent to the bucket before, whose last document it follows.
    """
    spark = docs.sparkSession
    batch_rows(spark, 200)
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    marks = rows.agg(F.percentile_approx("key", [k / (4 * n) for k in range(1, 4 * n)], 100 * n)).first()[0]
    bounds = np.unique(np.array(marks or [], np.int64))

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    # at most 4 n rows: the first document of each bucket, and the bucket that it follows (the last bucket for the first of all)
    firsts = sorted((r.b, r.key) for r in rows.select("key").withColumn("b", bucket("key")).groupBy("b").agg(F.max("key").alias("key")).collect())
    follows = dict(zip([key for _, key in firsts], [b for b, _ in firsts[1:]] + [firsts[0][0] if firsts else 0]))
    keys = np.array(sorted(follows), np.int64)
    targets = np.array([follows[k] for k in keys.tolist()], np.int32)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        """The bucket, and for a first document the one that it follows, as -1 - bucket."""
        x = key.to_numpy()
        own = np.searchsorted(bounds, x, side="left")
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return pd.Series([[int(b), -1 - int(targets[i])] if keys[i] == v else [int(b)] for b, i, v in zip(own, at, x)])

    placed = rows.withColumn("place", F.explode(places("key"))).withColumn("follows", F.col("place") < 0).withColumn("bucket", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))).withColumn("tie", F.xxhash64("text")).drop("place")
    ordered = placed.repartition(n, "bucket").sortWithinPartitions("bucket", "follows", F.col("key").desc(), "tie")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int | None, str]]:
        for batch in chunks(batches):
            yield from zip(col(batch, "bucket").to_pylist(), col(batch, "follows").to_pylist(), col(batch, "doc_id").to_pylist(), texts_of(batch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, str]] = []
        size = 0

        def done() -> pa.RecordBatch:
            changed = [(t[: len(t) - len(t) // 2] + x[: len(t) // 2]).encode() for _, t, x in held]
            # a text that follows is mostly the text of the next row
            texts = [t.encode() for _, t, _ in held]
            following = [held[i + 1][1] is held[i][2] if i + 1 < len(held) else False for i in range(len(held))]
            more = [x.encode() for (_, _, x), same in zip(held, following) if not same]
            found = fingerprints(texts + changed + more)
            own, edits, rest = found[: len(held)], found[len(held) : 2 * len(held)], iter(found[2 * len(held) :])
            after = [own[i + 1] if same else next(rest) for i, same in enumerate(following)]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in held], pa.int64()), pa.array([len(t) for _, t, _ in held], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed]), pa.array(own), pa.array(edits), pa.array(likeness(own, edits)), pa.array(likeness(own, after))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for row in _with_next(read(batches)):
            held.append(row)
            size += len(row[1])
            if size >= 1 << 20:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    return ordered.select("bucket", "follows", "doc_id", "text").mapInArrow(run, _OUT)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(documents(spark, sf_dir))
