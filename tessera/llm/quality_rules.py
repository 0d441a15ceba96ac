"""Quality rules by distribution divergence, in DataFrame operations alone.

Every text gets a histogram over classes of characters and one over the common words of its language. Both are held against
the same histograms of all texts of that language by Jensen-Shannon distance. Texts of too few words give no verdict by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, documents, extra, free, quoted

#: Common words of a language; the histogram has one class more for all other words.
COMMON = 16
#: The first rule: a text is dropped if the distance of its characters is over CHARACTERS.
CHARACTERS = 0.25
#: The second: if that of its words is over WORDS and that of its characters over CHARACTERS_TOO.
WORDS, CHARACTERS_TOO = 0.45, 0.12
#: Words that a text needs for these rules.
MIN_WORDS = 50
#: Words in a window that counts as repeated, words that a text needs, and percent of them that may be in repeated windows.
WINDOW, LEAST_WORDS, REPEATED = 8, 20, 30
#: Languages whose references are broadcast at most.
BROADCAST_LANGUAGES = 10_000

_SEPARATORS = "[ \\t-\\r]+"
_SYMBOLS = "#*$%&|<>"
_CLASSES = {"upper": "A-Z", "digit": "0-9", "mark": ".,;:!?'\"()-"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _but(text: Column, kept: str) -> Column:
    """How many characters of the class text has."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text."""
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def joined(h: Column, shift: int) -> Column:
        return F.zip_with(h, F.slice(h, F.lit(1 + shift), F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def repeated(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])
            return F.array_sort(F.transform(F.filter(F.transform(s, lambda e, j: F.when(same(e, j), e["i"])), lambda i: i.isNotNull()), lambda i: i))

        def covered(at: Column) -> Column:
            steps = F.zip_with(at, F.slice(at, F.lit(2), F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

        return _let(ordered, lambda s: _let(starts(s), covered))

    # hashes of 2, 4 and 8 words; the last seven have no full window
    eight = _let(_let(_let(hashes, lambda h: joined(h, 1)), lambda h: joined(h, 2)), lambda h: joined(h, 4))
    windows = F.slice(eight, F.lit(1), n - (WINDOW - 1))
    return F.when(n < WINDOW + 1, 0).otherwise(_let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(repeated(w)))).cast("long")


def _dup_lines(text: Column) -> Column:
    solid = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    return _let(solid, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long"))


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_NEW = (*_BASE, "char_distance", "word_distance", "base_failed", "kept")


def _measured(docs: DataFrame, text: str, lang: str, row: str) -> DataFrame:
    """row (all columns of docs), lang, words (array), chars, the characters of each class and the base measures. A null text is empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rare = F.regexp_replace(t, "[a-z \\t-\\r]+", "")  # all that the classes count, in a shorter text
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(row), t.alias("text"), rare.alias("rare"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.array_remove(F.split(t, _SEPARATORS, -1), "").alias("words"))
    return rows.select(
        row, "lang", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), _but(F.col("rare"), _SYMBOLS).alias("n_symbols"),
        _dup_lines(F.col("text")).alias("n_dup_lines"), _repeat_words(F.col("words")).alias("n_repeat_words"),
        *(_but(F.col("rare"), c).alias(name) for name, c in _CLASSES.items()), F.length("text").cast("long").alias("chars"),
    )


def _classes() -> list[Column]:
    """Characters of each class: upper case, digits, marks, symbols, separators, all others."""
    own = [F.col(c).cast("double") for c in ("upper", "digit", "mark", "n_symbols")]
    gaps = (F.col("chars") - F.col("word_chars")).cast("double")
    return [*own, gaps, F.col("chars").cast("double") - gaps - own[0] - own[1] - own[2] - own[3]]


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> DataFrame:
    """lang, class_share (array of doubles), common (array of words), word_share: of all texts of each language.

    Common words have the highest counts; of equal counts, the first in order. Texts without language are one of their own.
    Words are counted within tasks before they are shuffled, and their counts stored; sums over them need no list, and of the
    words of each group of a language `common` alone are sent on, whatever the size of its vocabulary.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang")
    lengths = docs.groupBy(name).agg(F.sum(F.length(t).cast("long")).alias("chars"))
    words = docs.select(name, F.explode(F.array_remove(F.split(t, _SEPARATORS, -1), "")).alias("word"))
    counts = Stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    # all classes but separators lie in words, so different words are enough to count them
    w = F.col("word")
    sizes = {"word_chars": F.length(w), "n_symbols": _but(w, _SYMBOLS), "n_words": F.lit(1)} | {k: _but(w, c) for k, c in _CLASSES.items()}
    sums = counts.df.groupBy("lang").agg(*(F.sum(F.col("n") * x).alias(k) for k, x in sizes.items()))
    first = [F.col("n").desc(), F.col("word")]
    some = counts.df.withColumn("part", F.pmod(F.xxhash64(w), F.lit(256)))
    for keys in (["lang", "part"], ["lang"]):  # the first words of each group, then those of the language
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*first))).where(F.col("r") <= common)
    top = some.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    joined = lengths.join(sums, "lang", "left").na.fill(0, list(sizes)).join(top, "lang", "left")
    share = F.transform(F.array(*_classes()), lambda x: x / F.greatest(F.col("chars"), F.lit(1)))
    top = F.coalesce(F.col("top"), F.array().cast("array<struct<r:int,word:string,n:bigint>>"))
    each = F.transform(top, lambda e: e["n"] / F.col("n_words"))
    rest = F.lit(1.0) - F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    word_share = F.when(F.col("n_words") == 0, F.array(F.lit(1.0))).otherwise(F.concat(each, F.array(rest)))
    return joined.select("lang", share.alias("class_share"), F.transform(top, lambda e: e["word"]).alias("common"), word_share.alias("word_share"))


def _distance(own: Column, other: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms whose shares add up to 1, rounded to 9 places."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(own, other, lambda p, q: part(p, q) + part(q, p))
    return F.round(F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)), 9)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with the base measures, char_distance, word_distance, base_failed and kept; columns of these names, in any case, are replaced.

    Null texts are empty: no words, so they fail for their length. Texts without lang are held against each other. Rows are
    judged each by itself, repeated ones alike; a distance that equals its bound passes. All other columns of docs, under any
    name, stay as they are. An empty table gives no rows.
    """
    kept = extra(docs, set(_NEW))
    docs = docs.select(*(F.col(quoted(c)) for c in kept))
    reference = Stored(references(docs, text, lang), "references").df
    if reference.count() <= BROADCAST_LANGUAGES:
        reference = F.broadcast(reference)
    row = free(["lang", "text", "rare", "words", "chars", "class_share", "common", "word_share", *_CLASSES, *_NEW], "row")
    rows = _measured(docs, text, lang, row).join(reference, "lang", "left")
    found = F.filter("words", lambda w: F.array_contains(F.col("common"), w))
    n = F.greatest(F.col("n_words"), F.lit(1))
    each = _let(found, lambda f: F.transform(F.col("common"), lambda c: F.size(F.filter(f, lambda w: w == c)) / n))
    own_words = _let(each, lambda e: F.concat(e, F.array(F.lit(1.0) - F.aggregate(e, F.lit(0.0), lambda a, x: a + x))))
    own_chars = F.transform(F.array(*_classes()), lambda x: x / F.greatest(F.col("chars"), F.lit(1)))
    long = F.col("n_words") >= MIN_WORDS
    rows = rows.withColumn("char_distance", F.when(long, _distance(own_chars, F.col("class_share"))))
    rows = rows.withColumn("word_distance", F.when(long, _distance(own_words, F.col("word_share"))))
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))
    far = (F.col("char_distance") > CHARACTERS) | ((F.col("word_distance") > WORDS) & (F.col("char_distance") > CHARACTERS_TOO))
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return rows.select(*(F.col(row)[c].alias(c) for c in kept), *_NEW)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def _distance_sql(p: str, q: str) -> str:
    part = lambda a, b: f"case when {a}[i] > 0 then {a}[i] * log2(2 * {a}[i] / ({a}[i] + {b}[i])) else 0 end"
    return f"round(sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(p, q)} + {part(q, p)})) / 2)), 9)"


_COUNTS_SQL = "[upper, digit, mark, n_symbols, chars - word_chars, word_chars - upper - digit - mark - n_symbols]"

OP4_SQL = f"""
with raw as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), measured as (
  select doc_id, lang, w, len(w)::bigint as n_words, length(t)::bigint as chars, length(regexp_replace(t, '[ \\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::bigint as upper,
    length(regexp_replace(t, '[^0-9]+', '', 'g'))::bigint as digit, length(regexp_replace(t, '[^.,;:!?''"()-]+', '', 'g'))::bigint as mark,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) as solid
  from raw
), windows as (
  select doc_id, pos, w[pos : pos + {WINDOW - 1}] as win from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as pos from measured where len(w) >= {WINDOW})
), twice as (
  select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, win) as n from windows) where n > 1
), repeated as (
  select doc_id, count(distinct word) as n_repeat_words from (select doc_id, unnest(range(pos, pos + {WINDOW})) as word from twice) group by doc_id
), sums as (
  select lang, {_COUNTS_SQL.replace("[", "[sum(").replace("]", ")]").replace(", ", "), sum(")} as counts, sum(chars) as chars, sum(n_words) as n from measured group by lang
), counted as (
  select lang, word, count(*) as n from (select lang, unnest(w) as word from measured) group by lang, word
), top as (
  select lang, list(word order by r) as common, list(n order by r) as ns
  from (select *, row_number() over (partition by lang order by n desc, word) as r from counted) where r <= {COMMON} group by lang
), reference as (
  select lang, list_transform(counts, lambda x: x / greatest(s.chars, 1)) as class_share, coalesce(common, []) as common,
    case when s.n = 0 then [1.0::double] else list_append(list_transform(ns, lambda x: x / s.n), 1.0 - list_sum(list_transform(ns, lambda x: x / s.n))) end as word_share
  from sums s left join top using (lang)
), own as (
  select m.*, r.class_share, r.word_share, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, (len(solid) - len(list_distinct(solid)))::bigint as n_dup_lines,
    list_transform({_COUNTS_SQL}, lambda x: x / greatest(chars, 1)) as class_own, list_transform(common, lambda c: len(list_filter(w, lambda x: x = c)) / greatest(n_words, 1)) as common_own
  from measured m left join reference r using (lang) left join repeated using (doc_id)
), full_own as (
  select *, list_append(common_own, 1.0 - coalesce(list_sum(common_own), 0)) as word_own from own
), distances as (
  select *, case when n_words >= {MIN_WORDS} then {_distance_sql("class_own", "class_share")} end as char_distance,
    case when n_words >= {MIN_WORDS} then {_distance_sql("word_own", "word_share")} end as word_distance,
    n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED} * n_words as base_failed
  from full_own
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(char_distance > {CHARACTERS} or (word_distance > {WORDS} and char_distance > {CHARACTERS_TOO}), false) as kept, char_distance, word_distance
from distances
"""
