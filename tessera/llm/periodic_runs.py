"""Periodic runs of words: Main-Lorentz divide and conquer over interned word ids, and texts without their repetitions.

A run is a stretch of words with smallest period q, of max(LEAST, 2 q) words or more, that no neighbouring word extends
keeping the period. find() cuts a text in two, finds the runs over the cut by Z-functions of both halves, and goes on in each
half. Stretches that cannot hold a run (see _stretches) are left out before; they hold nearly all of an ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_rows, chunks, documents, mix64, numbered, texts_of

#: Words of the shortest run.
LEAST = 12
#: Words of the windows that must recur within a run: one of length n and period q has n - q >= GRAM equal pairs q apart.
GRAM = LEAST // 2

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
NEW = ("runs", "collapsed")
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def z_function(s: list[int]) -> list[int]:
    """For each place of s, how many values from there on equal those from its beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _crossing(s: list[int], lo: int, mid: int, hi: int, least: int) -> Iterator[tuple[int, int, int]]:
    """start, end and period of stretches of s[lo:hi] over the cut before mid, of two periods and least words, as long as they get there."""
    left, right = s[lo:mid], s[mid:hi]
    back, ahead = left[::-1], right[::-1]
    n, m = len(left), len(right)
    # how far s agrees with itself p words on: from mid forwards, and from mid backwards
    forth_in_right, back_in_left = z_function(right), z_function(back)
    back_from_right = z_function(back + [-1] + ahead)
    forth_from_left = z_function(right + [-1] + left)
    for p in range(1, m + 1):
        f = forth_in_right[p] if p < m else 0
        b = back_from_right[n + 1 + m - p]
        b += back_in_left[p] if b == p < n else 0  # all p words agree, so left goes on against itself
        if f + b >= p and f + b + p >= least:
            yield mid - b, mid + p + f, p
    for p in range(1, n + 1):
        b = back_in_left[p] if p < n else 0
        f = forth_from_left[m + 1 + n - p]
        f += forth_in_right[p] if f == p < m else 0
        if f + b >= p and f + b + p >= least:
            yield mid - p - b, mid + f, p


def runs_of(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run of s, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    parts = [(0, len(s))]
    while parts:
        lo, hi = parts.pop()
        if hi - lo < least:
            continue
        mid = (lo + hi) // 2
        for a, b, p in _crossing(s, lo, mid, hi, least):
            # what goes on over an end of this part crosses the cut that made the end, and was found there
            if a == lo and lo and s[lo - 1] == s[lo - 1 + p] or b == hi and hi < len(s) and s[hi] == s[hi - p]:
                continue
            if p < found.get((a, b), p + 1):
                found[a, b] = p
        parts += [(lo, mid), (mid, hi)]
    return sorted((a, b - a, p) for (a, b), p in found.items())


def _stretches(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """text, start and end (words of that text) of stretches that hold all runs; ids are the words of all texts, ends where texts end.

    All of a run's windows of GRAM words but those at its last period recur q words on, so they begin in an unbroken series of
    k >= q - GRAM + 1 places whose windows recur after k + GRAM - 1 words at most; the run ends before two such series and
    2 GRAM words. Places in shorter series go, which makes series shorter, until none goes. Equal windows have equal hashes, so a
    collision keeps a place too many and loses none.
    """
    n = len(ids)
    if n < LEAST:
        return []
    with np.errstate(over="ignore"):
        gram = np.zeros(n - GRAM + 1, np.uint64)
        word = mix64(ids.astype(np.uint64) + np.uint64(1))
        for k in range(GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + word[k : n - GRAM + 1 + k]
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    order = np.argsort(gram, kind="stable")
    same = (gram[order[1:]] == gram[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    at = order[:-1][same]
    gap = order[1:][same] - at
    # windows over the end of a text are none
    inside = at + gap + GRAM <= ends[text[at]]
    at, gap = at[inside], gap[inside]
    by_place = np.argsort(at)
    at, gap = at[by_place], gap[by_place]
    while len(at):
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        sizes = np.diff(np.append(first, len(at)))
        keep = gap <= np.repeat(sizes, sizes) + GRAM - 1
        if keep.all():
            break
        at, gap = at[keep], gap[keep]
    if not len(at):
        return []
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    last = np.append(first[1:], len(at)) - 1
    out: list[list[int]] = []
    for a, b in zip(at[first].tolist(), at[last].tolist()):
        t = int(text[a])
        begins = int(ends[t - 1]) if t else 0
        a, b = a - begins, min(int(ends[t]) - begins, 2 * b - a - begins + 2 * GRAM)
        if out and out[-1][0] == t and out[-1][2] >= a:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([t, a, b])
    return [tuple(x) for x in out]


def analyse(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """The runs of each text, and its words, one space between them, without those that repeat what is before them in a run."""
    number: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(ends[-1]) if len(ends) else 0)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, a, b in _stretches(ids, ends):
        begins = int(ends[t - 1]) if t else 0
        found[t] += [(a + s, n, p) for s, n, p in runs_of(ids[begins + a : begins + b].tolist())]
    collapsed = []
    for ws, runs in zip(words, found):
        if runs:
            drop = np.zeros(len(ws), bool)
            for s, n, p in runs:
                drop[s + p : s + n] = True
            ws = [w for w, gone in zip(ws, drop.tolist()) if not gone]
        collapsed.append(b" ".join(ws))
    return found, collapsed


def find(docs: DataFrame) -> DataFrame:
    """docs with runs (start, length and period in words, by start) and collapsed (the text without repetitions).

    A null, empty or blank text has no run and an empty collapsed text. Texts of any length are one piece: time grows with
    n log n of its stretches with repetitions. Each row is by itself, so repeated rows and ties are as often in the result, and an
    empty table gives none. Columns named runs or collapsed, in any case, are replaced; all others come back unchanged.
    """
    batch_rows(docs.sparkSession)
    rows, names = numbered(docs, NEW)
    schema = rows.schema.simpleString()[len("struct<") : -1]
    rows = rows.withColumn("text", F.col(f"_{[n.lower() for n in names].index('text')}").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found, collapsed = analyse([t.encode() for t in texts_of(batch)])
            made = [pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], _RUN), pa.array([t.decode() for t in collapsed], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *NEW])

    return rows.mapInArrow(run, f"{schema},runs:{RUNS},collapsed:string").toDF(*names, *NEW)


def plant(docs: DataFrame) -> DataFrame:
    """docs with a periodic end in about a tenth of the texts, by a hash of doc_id; a null id leaves a text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    marked = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    g, n = F.floor(F.col("_h") / 10), F.size("_w")
    marked = marked.withColumn("_a", F.when(n > 0, F.pmod(g, n))).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))

    def moved(i: Column) -> Column:
        a = F.col("_a")
        return F.get(F.col("_w"), F.when(i >= a, a + F.pmod(i - a, F.col("_p"))).otherwise(i).cast("int"))

    changed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), moved), " ")
    return marked.withColumn("text", F.when(F.col("_a").isNotNull(), changed).otherwise(F.col("text"))).drop("_h", "_w", "_a", "_p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(plant(documents(spark, sf_dir).select("doc_id", "text")))
    # greatest length, then least start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), digest(listed).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
