"""Minimal pairs: the second end word of a rhyming couplet is replaced by one as frequent that does not rhyme."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_suffix, last_word, near_miss_bucket, replace_end, text_lines
from ..session import checkpointed
from .vectors import beside

#: Words of one bucket of frequencies that are sorted together.
SLICE_WORDS = 2048
#: Words of a block, cut from a sorted slice. The fewer, the more often their run recurs in a page of a file, which then is smaller.
BLOCK_WORDS = 128
#: Words of a stored part at most, on either side: a task has the pairs of two parts, and few enough different words for the
#: dictionaries of a file's columns.
PART_WORDS = 16384
#: Least width of a bucket (log2), so that there are few blocks however narrow the band is.
LEAST_WIDTH = 2.0**-6


def couplets(rows: DataFrame, text: str) -> DataFrame:
    """rows with lines (array), w1, w2: the last words of the first two lines."""
    rows = rows.withColumn("lines", text_lines(F.col(text)))
    return rows.withColumn("w1", last_word(F.get("lines", F.lit(0)))).withColumn("w2", last_word(F.get("lines", F.lit(1))))


def rhymes_of(pronunciations: DataFrame) -> DataFrame:
    """word, key from pronunciations (word, variant, phones: symbols with a space between, vowels with the digit of their stress).

    A word's first variant counts. Its key is what is said from the last stressed vowel (1 or 2) on, without digits; where none is
    stressed, all of it. A word that is not in the table has no key and rhymes with nothing.
    """
    first = pronunciations.where(F.col("word").isNotNull() & (F.trim("phones") != "")).groupBy("word").agg(F.min_by("phones", "variant").alias("phones"))
    parts = F.split(F.trim("phones"), r"\s+")
    stressed = F.array_position(F.reverse(F.transform(parts, lambda x: x.rlike("[12]$"))), F.lit(True)).cast("int")
    spoken = F.when(stressed > 0, F.slice(parts, -stressed, stressed)).otherwise(parts)
    return first.select("word", F.regexp_replace(F.array_join(spoken, " "), r"\d", "").alias("key"))


def build_pool(rows: DataFrame, text: str, rhymes: DataFrame) -> DataFrame:
    """word, n, log2, key: the words that end second lines, how often, and their rhyme keys from rhymes (word, key)."""
    return _pool(couplets(rows, text).where(F.size("lines") >= 2), rhymes)


def _pool(rows: DataFrame, rhymes: DataFrame) -> DataFrame:
    words = rows.where(F.col("w2") != "").groupBy(F.col("w2").alias("word")).agg(F.count("*").alias("n"))
    return words.join(rhymes.select("word", "key"), "word", "left").select("word", "n", F.pandas_udf(_log2, "double")("n").alias("log2"), "key")


def _log2(n: pd.Series) -> pd.Series:
    """Rounded to the nearest double, so that a word twice as frequent is at the band's edge wherever that is computed; the
    quotient of two logarithms, which is Spark's, lies beside it at times."""
    return n.map(math.log2)


def couplet_rhymes(rows: DataFrame, rhymes: DataFrame) -> DataFrame:
    """rows of couplets() with k1, k2 and rhymes: two lines, different end words, equal keys that are not empty."""
    return _rhymed(rows, F.size("lines"), rhymes)


def _rhymed(rows: DataFrame, n_lines: Column, rhymes: DataFrame) -> DataFrame:
    keys = rhymes.select("word", "key")
    rows = rows.join(keys.select(F.col("word").alias("w1"), F.col("key").alias("k1")), "w1", "left").join(keys.select(F.col("word").alias("w2"), F.col("key").alias("k2")), "w2", "left")
    return rows.withColumn("rhymes", F.coalesce((n_lines == 2) & (F.col("w1") != F.col("w2")) & (F.col("k1") != "") & (F.col("k1") == F.col("k2")), F.lit(False)))


def band_join(words: DataFrame, pool: DataFrame, band: float, near_miss: str = "include") -> DataFrame:
    """words (w1, k1, w2) with every pool word as frequent as w2 within band (log2), which neither is w1 or w2 nor rhymes.

    Words are of any type, keys too. Both sides are packed into blocks of like frequency, each word once, and every part of one side
    meets every part of the other where it is stored: what is shuffled grows as the rows of the sides, however many pairs there are.
    Blocks too far apart are left out whole. Pairs come by blocks, with the pool words in one order for each w2, so that files of
    them are small.
    """
    base = pool.select(F.col("word").alias("w2"), F.col("log2").alias("c"))
    width = max(band / 4, LEAST_WIDTH)
    asks = _blocks(checkpointed(words.select("w1", "k1", "w2").join(base, "w2")), ["c", "k1", "w2", "w1"], width)
    spoken = F.col("key").isNotNull() & (F.col("key").cast("string") != "")
    offers = _blocks(pool.where(spoken).select(F.col("log2").alias("l"), F.col("key").alias("k"), F.col("word").alias("w")), ["l", "k", "w"], width)
    # a difference of two doubles grows with the first and falls with the second, so no pair within the band is left out
    met = beside(offers, asks, (F.col("a_low") - F.col("b_high") <= band) & (F.col("b_low") - F.col("a_high") <= band))
    met = met.select("a_low", "a_high", "a_rows", F.inline("b_rows")).where((F.col("a_low") - F.col("c") <= band) & (F.col("c") - F.col("a_high") <= band))
    rows = met.select("w2", "w1", "k1", "c", F.inline("a_rows")).where((F.abs(F.col("l") - F.col("c")) <= band) & (F.col("w") != F.col("w1")) & (F.col("w") != F.col("w2")) & (F.col("k") != F.col("k1")))
    if near_miss == "exclude":
        rows = rows.where(common_suffix(F.col("w1"), F.col("w")) < 2)
    return rows.select("w2", "w1", "k1", "c", "w", "k")


def _blocks(rows: DataFrame, columns: list[str], width: float) -> DataFrame:
    """low, high, rows: some rows of one bucket of the first of the columns, sorted by them, with its least and greatest value.
    Dealt over a number of parts that does not follow from their bytes."""
    spark, at = rows.sparkSession, columns[0]
    rows = rows.where(F.abs(at) < math.inf).withColumn("_b", F.floor(F.col(at) / width))
    # a row for each bucket, of which there are as many as logarithms of counts in widths
    sizes = rows.groupBy("_b").agg(F.count("*").alias("n")).select("_b", "n", F.ceil(F.col("n") / SLICE_WORDS).cast("int").alias("_k"))
    n, slices = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("_k"), F.lit(0))).first()
    parts = max(1, min(slices, max(spark.sparkContext.defaultParallelism, -(-n // PART_WORDS))))
    rows = rows.join(F.broadcast(sizes.drop("n")), "_b").withColumn("_s", F.pmod(F.xxhash64(*columns), F.col("_k")).cast("int"))
    slices = rows.repartition(parts, "_b", "_s").groupBy("_b", "_s").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    starts = F.sequence(F.lit(1), F.size("rows"), F.lit(BLOCK_WORDS))
    blocks = slices.select(F.explode(F.transform(starts, lambda i: F.slice("rows", i, BLOCK_WORDS))).alias("rows"))
    return blocks.select(F.get("rows", F.lit(0))[at].alias("low"), F.element_at("rows", -1)[at].alias("high"), "rows")


def ends(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_lines, lines, w1, w2 of couplets(), stored: lines are those of texts of two lines, null for others, so that no other
    text is read again or travels."""
    c = couplets(rows.select(key, text), text)
    n = F.size("lines").alias("n_lines")
    return checkpointed(c.select(key, n, F.when(F.size("lines") == 2, F.col("lines")).alias("lines"), "w1", "w2"))


def build_split(rows: DataFrame, key: str, text: str, rhymes: DataFrame | Callable[[DataFrame], DataFrame], slot: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], negatives: int = 2, candidates: int = 8, band: float = 1.0, max_gap: float = 10.0, eos_gap: float = 2.0, near_miss: str = "include") -> tuple[DataFrame, DataFrame]:
    """(minimal pairs, a reason for every row): candidates by frequency, the band doubled for rows with too few, then ranked by two scorers.

    slot adds slot_logp to (key, prefix, w); score adds logp and eos_logp to (key, text). Both are for a model to fill in. rhymes may
    be made from the rows of ends().
    """
    found = ends(rows, key, text)
    if callable(rhymes):
        rhymes = checkpointed(rhymes(found))
    rhymed = checkpointed(_rhymed(found, F.col("n_lines"), rhymes).select(key, "n_lines", "lines", "w1", "w2", "k1", "rhymes"))
    pool = checkpointed(_pool(found.where("n_lines >= 2"), rhymes))
    whole = rhymed.where("rhymes").select(key, "lines", "w1", "w2", "k1")
    words = whole.select("w1", "k1", "w2").distinct()
    narrow = band_join(words, pool, band, near_miss).select("w1", "w2", "w")
    enough = narrow.groupBy("w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") >= negatives).select("w1", "w2")
    wide = band_join(words.join(enough, ["w1", "w2"], "left_anti"), pool, 2 * band, near_miss).select("w1", "w2", "w")
    found = narrow.join(enough, ["w1", "w2"]).union(wide)
    prefix = F.concat(F.get("lines", F.lit(0)), F.lit("\n"), replace_end(F.get("lines", F.lit(1)), F.lit("")))
    offered = checkpointed(whole.join(found, ["w1", "w2"]).withColumn("prefix", prefix))
    best = Window.partitionBy(key).orderBy(F.col("slot_logp").desc(), "w")
    # what the scorers give is stored: each is asked once for a text
    short = checkpointed(slot(offered).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= candidates).drop("_r", "slot_logp"))
    chosen = F.concat(F.get("lines", F.lit(0)), F.lit("\n"), F.get("lines", F.lit(1)))
    texts = short.select(key, "w1", "w2", "w", chosen.alias("chosen"), F.concat(F.get("lines", F.lit(0)), F.lit("\n"), replace_end(F.get("lines", F.lit(1)), F.col("w"))).alias("rejected"))
    base = score(texts.select(key, F.col("chosen").alias("text")).distinct()).select(key, F.col("logp").alias("logp_c"), F.col("eos_logp").alias("eos_c"))
    scored = score(texts.withColumn("text", F.col("rejected"))).withColumnRenamed("logp", "logp_r").withColumnRenamed("eos_logp", "eos_r").join(base, key)
    ranked = checkpointed(scored.withColumn("closes", F.col("eos_r") >= F.col("eos_c") - eos_gap).withColumn("near", F.col("logp_r") >= F.col("logp_c") - max_gap))
    order = Window.partitionBy(key).orderBy(F.col("logp_r").desc(), "w")
    kept = ranked.where("closes and near").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= negatives)
    tally = ranked.groupBy(key).agg(F.count_if("closes").alias("closes"), F.count_if(F.col("closes") & F.col("near")).alias("good"))
    full = tally.where(F.col("good") >= negatives).select(key)
    pairs = kept.join(full, key).select(key, "chosen", "rejected", near_miss_bucket(common_suffix(F.col("w1"), F.col("w"))).alias("near_miss"), F.col("w").alias("replacement"), (F.col("logp_r") - F.col("logp_c")).alias("gap"), (F.col("eos_c") - F.col("eos_r")).alias("eos_gap"))
    offers = offered.groupBy(key).agg(F.count("*").alias("offers"))
    reason = F.when(F.col("n_lines") != 2, "not two lines").when(~F.col("rhymes"), "no rhyme").when(F.coalesce("offers", F.lit(0)) < negatives, "no candidates").when(F.coalesce("closes", F.lit(0)) < negatives, "eos").when(F.col("good") < negatives, "gap")
    return pairs, rhymed.join(offers, key, "left").join(tally, key, "left").select(key, reason.alias("reason"))


def minimal_report(pairs: DataFrame) -> DataFrame:
    """One row: rows, mean gap, upper-middle median gap, share of likelier negatives, mean eos gap."""
    from .order import quantiles, upper_middle_rule

    row = pairs.agg(F.count("*").alias("rows_out"), F.avg("gap").alias("mean_gap"), F.avg((F.col("gap") > 0).cast("double")).alias("frac_rejected_more_likely"), F.avg("eos_gap").alias("mean_eos_gap"))
    return row.crossJoin(quantiles(pairs, "gap", {"median_gap": upper_middle_rule()}))


def top_values(rows: DataFrame, column: str, k: int = 15) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(k)
