"""Near-duplicate detection: banded MinHash candidates, checked by odd sketches and confirmed on full shingle sets.

Documents with equal sets (of 64-bit shingle hashes, told apart by 128 bits) form a class at once. Each class has SAMPLES MinHash values: BANDS bands of them are the buckets
that candidates share, and all of them are folded into an odd sketch, a bitmap of parities, where the population count of
the XOR of two sketches estimates the similarity. Buckets are never expanded into pairs:

1. Every class of a bucket is held against one class of it, the one that shares most buckets with others (in a group of
   copies, that is one near their source). Links are confirmed, components follow.
2. A pair of one bucket that is not yet in one component has a class outside the bucket's largest component. These
   stragglers are held against all classes of the bucket, in blocks of BLOCK by BLOCK classes, by precise sketches, which
   are made for the classes of such buckets alone, a pair in the first bucket that it shares. At first each straggler's
   likeliest class in another component is confirmed. What is then still apart is held against each other once more, and every likely pair is confirmed.

So every pair of a bucket is either connected already or compared. A pair at the least similarity shares no bucket with a
probability of (1 - 0.8**ROWS)**BANDS, about 1e-7; for what sketches lose see LEAST_ESTIMATE. Pairs that precise sketches
let through are not held against the coarse ones again.

No key is left whole to one task: a hot bucket, hub or class is split by a salt wherever rows meet it (see spread). Texts
are not shuffled to fetch the sets of candidates as long as those are few enough to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, batch_rows, chunks, col, documents, free, mix64, partitions, quoted, span_hashes, words

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sketches pass from this estimate on: of 1,120,000 pairs that share 8 of 10 shingles, 85 were below 0.66, 2 below 0.62 and none below 0.6.
LEAST_ESTIMATE = 0.6
#: The precise sketches, of ten times as many samples, pass from five deviations below it on.
PRECISE_SAMPLES, PRECISE_BITS, PRECISE_ESTIMATE = 2048, 4096, 0.75
BLOCK = 512
#: Keys with more rows than this, and than an eighth of a task's share, are split: so there are at most 8 of them a task.
HOT_ROWS = 1000
#: Rows of 32 bytes at most that are broadcast to texts, so as not to shuffle these; beyond that, both sides are shuffled.
BROADCAST_ROWS = 1 << 18
#: Links whose components one task finds, in 16 bytes each; more of them go through rounds of stars.
FEW_LINKS = 1 << 17

_SEED = np.random.default_rng(71)
_MULTIPLIERS = _SEED.integers(0, 1 << 32, PRECISE_SAMPLES, dtype=np.uint32) | np.uint32(1)
_MASKS = _SEED.integers(0, 1 << 32, PRECISE_SAMPLES, dtype=np.uint32)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, one after the other, and how many each has."""
    data, starts, ends, counts = words(texts)
    each = span_hashes(data, starts, ends)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    left = np.repeat(counts, per)
    acc = np.zeros(len(first), np.uint64)
    for j in range(n):
        more = left > j  # texts of fewer words are one shingle of all their words
        acc = np.where(more, acc * np.uint64(0xD6E8FEB86659FD93) + each[np.minimum(first + j, max(len(each) - 1, 0))], acc) if len(each) else acc
    acc = mix64(acc)
    out, sizes, at = [], np.zeros(len(texts), np.int64), 0
    for i, k in enumerate(per.tolist()):
        own = np.unique(acc[at : at + k])
        out.append(own)
        sizes[i] = len(own)
        at += k
    return np.concatenate(out) if out else acc, sizes


def minhashes(sets: np.ndarray, sizes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """[sample, set] for sets that are not empty."""
    at = np.cumsum(sizes) - sizes
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((samples, len(sizes)), np.uint32)
    if len(sizes):
        for k in range(samples):
            out[k] = np.minimum.reduceat((x ^ _MASKS[k]) * _MULTIPLIERS[k], at)
    return out


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """[set, bits / 64]: each sample flips one bit."""
    k, n = samples.shape
    flips = np.zeros((n, bits), np.uint8)
    rows = np.arange(n)
    for i in range(k):
        flips[rows, mix64(samples[i].astype(np.uint64) + (np.uint64(i) << np.uint64(32))) % np.uint64(bits)] ^= 1
    return np.packbits(flips, axis=1).view(np.uint64)


def estimate(left: np.ndarray, right: np.ndarray, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarities of the pairs of sketches left[i], right[i]."""
    odd = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    different = -bits / 2 * np.log(np.maximum(1 - 2 * odd / bits, 1e-9))
    return 1 - different / (2 * samples)


def hot(sizes: DataFrame, key: str, total: int) -> DataFrame | None:
    """Of sizes (key, n: rows with it, total in all) the hot keys and their number of salts; None if there are none."""
    spark = sizes.sparkSession
    limit = max(HOT_ROWS, total // (8 * partitions(spark)))
    if total <= limit:
        return None
    found = sizes.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("salts")).collect()  # total / limit rows at most
    return F.broadcast(spark.createDataFrame(found, f"{key} long, salts int")) if found else None


def spread(rows: DataFrame, facts: DataFrame, key: str, by: str, salts: DataFrame | None) -> DataFrame:
    """rows joined with facts (one row a key). The rows of a hot key go to several tasks by the column `by`, and its facts to each of them."""
    if salts is None:
        return rows.join(facts, key)
    left = rows.join(salts, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    right = facts.join(salts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")


_SIGNED = "doc_id long, digest long, n_shingles long, node long, proof long, bands array<long>, sketch binary"
_SALTS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D))


def _set_hash(sets: np.ndarray, at: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """One of two independent 64-bit hashes of sets that are not empty."""
    return mix64(np.add.reduceat(mix64(sets ^ _SALTS[k]), at) + sizes.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)


def signatures(docs: DataFrame, shingle: int, node_bits: int = 64) -> DataFrame:
    """node and proof: two hashes of the whole set; null, as are bands and sketch, for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            raw = [x or b"" for x in col(batch, "text").cast(pa.binary()).to_pylist()]
            sets, sizes = shingle_sets(raw, shingle)
            full = np.flatnonzero(sizes)
            own = sizes[full]
            at = np.cumsum(own) - own
            node, proof = (_set_hash(sets, at, own, k) for k in (0, 1))
            node >>= np.uint64(64 - node_bits)
            samples = minhashes(sets, own)
            sketch = odd_sketches(samples)
            acc = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(full), axis=1)
            for r in range(ROWS):
                acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + samples[r::ROWS])
            bands = acc.T.astype(np.int64)
            place = np.full(len(raw), -1)
            place[full] = np.arange(len(full))
            hashes = [pa.array([int(x[k].astype(np.int64)) if k >= 0 else None for k in place], pa.int64()) for x in (node, proof)]
            yield pa.RecordBatch.from_arrays(
                [
                    col(batch, "doc_id"),
                    col(batch, "digest"),
                    pa.array(sizes),
                    *hashes,
                    pa.array([bands[k] if k >= 0 else None for k in place], pa.list_(pa.int64())),
                    pa.array([sketch[k].tobytes() if k >= 0 else None for k in place], pa.binary()),
                ],
                names=["doc_id", "digest", "n_shingles", "node", "proof", "bands", "sketch"],
            )

    return docs.select("doc_id", "digest", "text").mapInArrow(run, _SIGNED)


def _row() -> Column:
    """What a row is found by again and comes first by: its id, or without one its text's hash, and that hash."""
    return F.struct(F.col("doc_id").isNull().alias("noid"), F.coalesce("doc_id", "digest").alias("key"), "digest")


def _sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, shingle: int, precise: bool = False) -> DataFrame:
    """node, and the set (or its precise sketch) of the classes wanted: node, proof, and noid and key of one of their documents."""
    name = "precise" if precise else "set"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            sets, sizes = shingle_sets([x or b"" for x in col(batch, "text").cast(pa.binary()).to_pylist()], shingle)
            at = np.cumsum(sizes) - sizes
            full = np.flatnonzero(sizes)
            proof = np.zeros(len(sizes), np.int64)
            proof[full] = _set_hash(sets, at[full], sizes[full], 1).astype(np.int64)
            # of several rows of an id, the one meant
            meant = full[proof[full] == col(batch, "proof").to_numpy()[full]]
            values = [sets[at[k] : at[k] + sizes[k]] for k in meant]
            if precise and values:
                values = odd_sketches(minhashes(np.concatenate(values), sizes[meant], PRECISE_SAMPLES), PRECISE_BITS)
            yield pa.RecordBatch.from_arrays([col(batch, "node").take(pa.array(meant, pa.int64())), pa.array([x.tobytes() for x in values], pa.binary())], names=["node", name])

    wanted = F.broadcast(wanted) if n_wanted <= BROADCAST_ROWS else wanted
    rows = docs.select("text", F.col("doc_id").isNull().alias("noid"), F.coalesce("doc_id", "digest").alias("key")).join(wanted, ["noid", "key"])
    found = rows.select("node", "proof", "text").mapInArrow(run, f"node long, {name} binary")
    return found.dropDuplicates(["node"])


def _wanted(nodes: DataFrame, classes: DataFrame) -> Stored:
    return Stored(nodes.distinct().join(classes, "node").select("node", "proof", "first.noid", "first.key"), "wanted")


def _confirm(links: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, stored: list[Stored], coarse: bool) -> DataFrame | None:
    """Of the candidates (a, b), those whose full sets are similar enough; None if there are none, or sketches (coarse) let none of them through."""

    def sides(pairs: DataFrame, facts: DataFrame, total: int) -> DataFrame:
        """pairs with the facts of both classes, named by _a and _b; a class of many pairs is split."""
        salts = {s: hot(pairs.groupBy(s).agg(F.count("*").alias("n")), s, total) for s in "ab"}
        for s, other in ("ab", "ba"):
            own = facts.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in facts.columns if c != "node"))
            pairs = spread(pairs, own, s, other, salts[s])
        return pairs

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(col(batch, c).to_pylist()), np.uint64).reshape(len(batch), -1) for c in ("sketch_a", "sketch_b"))
                keep = pa.array(estimate(x, y) >= LEAST_ESTIMATE)
                yield pa.RecordBatch.from_arrays([col(batch, c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(col(batch, "set_a").to_pylist(), col(batch, "set_b").to_pylist()):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([col(batch, c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    likely = Stored(links, "likely")
    total = likely.df.count()
    if coarse and total:
        near = sides(likely.df, classes.select("node", "n_shingles", "sketch"), total).where(100 * F.least("n_shingles_a", "n_shingles_b") >= PERCENT * F.greatest("n_shingles_a", "n_shingles_b"))
        fewer = Stored(near.select("a", "b", "sketch_a", "sketch_b").mapInArrow(sketched, "a long, b long"), "likely")
        likely.drop()
        likely, total = fewer, fewer.df.count()
    if not total:
        likely.drop()
        return None
    wanted = _wanted(likely.df.select(F.col("a").alias("node")).union(likely.df.select("b")), classes)
    sets = Stored(_sets(docs, wanted.df, wanted.df.count(), shingle), "sets", "snappy")
    out = Stored(sides(likely.df, sets.df, total).select("a", "b", "set_a", "set_b").mapInArrow(similar, "a long, b long"), "links")
    for s in (sets, wanted, likely):
        s.drop()
    stored.append(out)
    return out.df


def _trees(edges: DataFrame) -> DataFrame:
    """(a, b): every node but the roots with the least node of its component, found in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.stack([col(x, "a").to_numpy(), col(x, "b").to_numpy()]) for x in batches]
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        names, ends = np.unique(pairs, return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(names))
        while True:  # every root takes the least root that it is linked with; then all nodes go up to their roots
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (root[root] != root).any():
                root = root[root]
        lower = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[lower]), pa.array(names[root[lower]])], names=["a", "b"])

    return edges.coalesce(1).mapInArrow(run, "a long, b long")


def components(links: DataFrame, few: int = FEW_LINKS) -> Stored:
    """(node, root) for every node of links (a, b) but the roots, which are the least nodes of their components.

    Up to `few` links go to one task; of more, large and small stars are made in turn, till nothing changes. A hub's edges are split.
    """
    edges = Stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges.df)
    if 0 < before[0] <= few:
        found = Stored(_trees(edges.df), "edges")
        edges.drop()
        edges, before = found, (0,)
    while before[0]:
        e = edges.df
        both = e.union(e.select("b", "a"))
        least = Stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
        hubs = hot(least.df, "a", 2 * before[0])
        large = Stored(spread(both, least.df.drop("n"), "a", "b", hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lower = Stored(large.df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lower")
        hubs = hot(lower.df, "a", 2 * before[0])
        small = spread(large.df, lower.df.drop("n"), "a", "b", hubs).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = Stored(small.union(lower.df.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        for x in (edges, least, large, lower):
            x.drop()
        edges, after = nxt, state(nxt.df)
        if after == before:
            break
        before = after
    edges.df = edges.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return edges


def _open_rows(held: DataFrame, roots: DataFrame, total: int) -> tuple[DataFrame, Stored]:
    """The rows of buckets in several components, with the largest of these and how many blocks the bucket makes; and what they read."""
    # with two classes, the pair with the leading one was all
    rows = held.where("n > 2").join(roots, "node", "left").select("bucket", "node", "lead", F.coalesce("root", "node").alias("root"))
    by_root = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    whole = by_root.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    open_ = Stored(whole.select("bucket", "main", "n", blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("most")).alias("some_blocks")), "open")
    return spread(rows, open_.df.drop("n"), "bucket", "node", hot(open_.df, "bucket", total)), open_


def _stragglers(rows: DataFrame, sketches: DataFrame, best: bool) -> DataFrame:
    """Likely pairs (a, b) of one bucket in different components, one of them outside the bucket's largest.

    best: of each straggler only the likeliest, in each block.
    """
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.join(sketches, "node")
    kept = ["bucket", "node", "root", "lead", "n_shingles", "bands", "precise"]
    every = rows.select(*kept, F.lit(False).alias("out"), own(F.col("all_blocks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("some_blocks") - 1)).alias("j"))
    outside = rows.where("root <> main").select(*kept, F.lit(True).alias("out"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("i"), own(F.col("some_blocks")).alias("j"))
    ordered = every.union(outside).withColumn("block", F.xxhash64("bucket", "i", "j")).repartition(partitions(rows.sparkSession), "block").sortWithinPartitions("block", "bucket", "out", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            block = table.column("block").to_numpy()
            others = np.flatnonzero(block != block[-1])
            if len(others):
                yield from compare(table.slice(0, int(others[-1]) + 1))
                held = table.slice(int(others[-1]) + 1).to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held))

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: table.column(c).to_numpy()
        block, bucket, out, node, root, lead, size = (get(c) for c in ("block", "bucket", "out", "node", "root", "lead", "n_shingles"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(block), BANDS)
        sketch = np.frombuffer(b"".join(table.column("precise").to_pylist()), np.uint64).reshape(len(block), -1)
        begin = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        outs = np.add.reduceat(out.astype(np.int64), begin)
        alls = np.diff(np.r_[begin, len(block)]) - outs
        # each straggler with the classes of its block, some stragglers at a time
        lone = np.flatnonzero(out)
        of = np.repeat(np.arange(len(begin)), outs)
        step = max(1, 20_000 // max(1, int(alls.max())))
        for k in range(0, len(lone), step):
            s, g = lone[k : k + step], of[k : k + step]
            x = np.repeat(s, alls[g])
            y = np.repeat(begin[g], alls[g]) + np.arange(len(x)) - np.repeat(np.cumsum(alls[g]) - alls[g], alls[g])
            fit = (root[x] != root[y]) & (node[x] != lead[x]) & (node[y] != lead[x]) & (100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y]))
            x, y = x[fit], y[fit]
            likely = estimate(sketch[x], sketch[y], PRECISE_SAMPLES, PRECISE_BITS)
            near = likely >= PRECISE_ESTIMATE
            x, y, likely = x[near], y[near], likely[near]
            # a pair counts in the first bucket that it shares
            here = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == bucket[x]
            x, y, likely = x[here], y[here], likely[here]
            if best and len(x):
                order = np.lexsort((node[y], -likely, x))
                x, y = x[order], y[order]
                first = np.r_[True, x[1:] != x[:-1]]
                x, y = x[first], y[first]
            p, q = node[x], node[y]
            pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _classes(signed: DataFrame, stored: list[Stored]) -> tuple[DataFrame, DataFrame]:
    """A row for each different set: node (told apart from others by proof), first (see _row), rep, n, and what belongs to the set; and signed with these nodes."""
    groups = signed.where("node is not null").withColumn("row", _row()).groupBy("node", "proof")
    classes = Stored(groups.agg(F.min("row").alias("first"), F.min("doc_id").alias("rep"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch"))), "classes")
    stored.append(classes)
    twice = Stored(classes.df.groupBy("node").agg(F.count("*").alias("k"), F.min("proof").alias("main")).where("k > 1").select("node", "main"), "twice")
    if not twice.df.count():
        twice.drop()
        return classes.df, signed
    # different sets of one node: all but one of them get another

    def apart(rows: DataFrame) -> DataFrame:
        other = F.coalesce(F.col("proof") != F.col("main"), F.lit(False))
        return rows.join(twice.df, "node", "left").withColumn("node", F.when(other, F.xxhash64("node", "proof")).otherwise(F.col("node"))).drop("main")

    classes = Stored(apart(classes.df), "classes")
    stored.append(classes)
    return classes.df, apart(signed)


def _judged(docs: DataFrame, shingle: int, node_bits: int = 64) -> DataFrame:
    """doc_id, digest (a hash of the text), n_shingles, component_id, kept, and stays: true for the first row of each component (see _row) and for empty sets."""
    batch_rows(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    stored: list[Stored] = []
    signed = Stored(signatures(docs, shingle, node_bits), "signed")
    classes, rows = _classes(signed.df, stored)
    members = classes.select("node", F.explode("bands").alias("bucket"))
    shared = Stored(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    total = shared.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = hot(shared.df, "bucket", total)
    inner = Stored(spread(members, shared.df, "bucket", "node", buckets), "buckets")
    popular = inner.df.groupBy("node").agg(F.sum("n").alias("popular"))
    leads = inner.df.join(popular, "node").groupBy("bucket").agg(F.max_by("node", F.struct("popular", "node")).alias("lead"))
    held = Stored(spread(inner.df, leads, "bucket", "node", buckets), "held")
    for s in (inner, shared):
        s.drop()
    links = _confirm(held.df.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), classes, docs, shingle, stored, coarse=True)
    roots = components(links if links is not None else held.df.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    apart, read = _open_rows(held.df, roots.df, total)
    wanted = _wanted(apart.select("node"), classes)
    sketches = _sets(docs, wanted.df, wanted.df.count(), shingle, precise=True)
    precise = Stored(sketches.join(classes.select("node", "n_shingles", "bands"), "node"), "precise")
    wanted.drop()
    for best in (True, False):
        more = _confirm(_stragglers(apart, precise.df, best), classes, docs, shingle, stored, coarse=False)
        read.drop()
        if more is None:
            break  # no pair that precise sketches let through is apart, so there is none in the second pass either
        merged = components(roots.df.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        roots.drop()
        roots = merged
        if best:
            apart, read = _open_rows(held.df, roots.df, total)
    linked = Stored(roots.df.union(roots.df.select("root", "root").distinct()).join(classes.select("node", "rep", "first"), "node"), "linked")
    least = Stored(linked.df.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("first").alias("start"), F.count("*").alias("n")), "least")
    names = spread(linked.df, least.df.drop("n"), "root", "node", hot(least.df, "root", linked.df.count())).select("node", "component_id", "start")
    named = Stored(classes.select("node", "rep", "first").join(names, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("start", "first").alias("start")), "components")
    copies = hot(classes.select("node", "n"), "node", classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    for s in (*stored, held, precise, roots, linked, least):
        s.drop()
    own = rows.select("doc_id", "digest", "n_shingles", "node").where("node is not null")
    component = spread(own, named.df, "node", "doc_id", copies)
    component = component.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))).withColumn("stays", _row().eqNullSafe(F.col("start"))).drop("node", "start")
    empty = rows.where("node is null").select("doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("stays"))
    return component.unionByName(empty)


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to), kept (whether that is the document itself).

    A set is the distinct `shingle`-word shingles of the whole text, however long, with A-Z lowered; with fewer words it is
    all of them as one; null texts and texts without words have an empty set, are linked with nothing and stay. Rows with one
    id and different texts are compared each by itself; repeated rows have the same component and flag. Rows without id are
    linked like others: their component is that of the ids they lead to, and null (with kept true) if there are none. Ties
    cannot change the result: a component is all that links reach. Other columns are ignored; an empty table gives no rows.
    """
    return _judged(docs, shingle).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs with one row of each component of near duplicates, and all rows with empty sets; its columns are left as they are.

    The row with the least doc_id stays, of several with that id the one with the least hash of its text, of rows that are
    equal in both any one; a component without ids keeps the row with the least hash.
    """
    noid, key, digest = (free(docs.columns, c) for c in ("noid", "key", "digest"))
    ids = {noid: F.col("doc_id").isNull(), key: F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))), digest: F.xxhash64(F.col("text").cast("string"))}
    rows = Stored(_judged(docs, shingle).where("n_shingles > 0").select("stays", F.col("doc_id").isNull().alias(noid), F.coalesce("doc_id", "digest").alias(key), F.col("digest").alias(digest)).groupBy("stays", noid, key, digest).agg(F.count("*").alias("n")), "judged").df

    def bounded(found: DataFrame) -> tuple[DataFrame, int]:
        n = found.count()
        return (F.broadcast(found) if n <= BROADCAST_ROWS else found), n

    gone, _ = bounded(rows.where(~F.col("stays")).select(noid, key, digest))
    twice, n_twice = bounded(rows.where(F.col("stays") & (F.col("n") > 1)).select(noid, key, digest))
    left = docs.withColumns(ids).join(gone, [noid, key, digest], "left_anti")
    if n_twice:
        again = left.join(twice, [noid, key, digest], "left_semi").dropDuplicates([noid, key, digest])
        left = left.join(twice, [noid, key, digest], "left_anti").unionByName(again)
    return left.select(*(F.col(quoted(c)) for c in docs.columns))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=2)


#: Exact, by prefixes of each set with its rarest shingles first: sets of similarity 0.8 share a shingle of those.
OP3_SQL = """
with recursive raw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), shingles as (
  select distinct doc_id, s from (select doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from raw where len(w) > 0))
), counted as (
  select doc_id, s, count(*) over (partition by doc_id) as n, count(*) over (partition by s) as df from shingles
), ranked as (
  select *, row_number() over (partition by doc_id order by df, s) as r from counted
), prefixes as (
  select * from ranked where r <= n - (8 * n + 9) // 10 + 1
), candidates as (
  select distinct a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny from prefixes a join prefixes b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links as (
  select x, y from (select c.x, c.y, nx, ny, count(*) as shared from candidates c join shingles a on a.doc_id = c.x join shingles b on b.doc_id = c.y and a.s = b.s group by all) where 100 * shared >= 80 * (nx + ny - shared)
), edges as (
  select x, y from links union all select y, x from links
), reach as (
  select doc_id, doc_id as other from documents union select r.doc_id, e.y from reach r join edges e on e.x = r.other
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id, min(other) = doc_id as kept from reach left join sizes using (doc_id) group by doc_id
"""
