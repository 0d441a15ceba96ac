"""Line deduplication by site-relative frequency, in DataFrame operations alone.

For every host, a line's frequency is the share of the host's pages that contain it. Lines over the boilerplate ratio are
dropped from the host's pages. Lines are compared by a 64-bit hash of their text without blanks around it; a page counts
once for a line, however often it has it. Copies of a page count each, or, as in the pipeline, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, documents, extra, free, quoted

#: A line in more than this share of a host's pages is boilerplate.
RATIO = 0.08
#: Hashes of boilerplate lines that are broadcast at most (8 bytes each); beyond that, pages are joined by shuffle.
BROADCAST_LINES = 1 << 20


def _key(line: Column) -> Column:
    return F.xxhash64(_trim(line))


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column) -> Column:
    """Hashes of the different lines of a text that are not blank."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: _trim(x) != ""), _key))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int = 2, copies: bool = True) -> DataFrame:
    """host, dropped (hashes of its boilerplate lines). A page has few lines over the ratio, so a host has few of them in all:
    no more than the mean number of lines of its pages divided by the ratio. Without copies, a host's pages are its distinct texts."""
    hosted = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("page"))
    pages = hosted.where(F.col("page").isNotNull())
    if copies:
        bags = pages.select("host", _keys(F.col("page")).alias("keys"))
    else:  # hashes of texts and lines are shuffled, not texts
        bags = pages.select("host", F.xxhash64("page").alias("id"), _keys(F.col("page")).alias("keys")).dropDuplicates(["host", "id"])
        hosted = hosted.select("host", F.xxhash64("page").alias("id")).distinct()
    counted = bags.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = hosted.groupBy("host").agg(F.count("*").alias("pages"))
    over = counted.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("dropped"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = 2, copies: bool = True, most: float = 1.0) -> DataFrame:
    """docs with boilerplate lines taken out of text, and the columns n_lines and n_dropped (lines that are not blank).

    Boilerplate is what pages share, so a line that one page alone has is none, whatever its ratio (min_pages; more is the
    caller's choice). Columns n_lines and n_dropped, in any case, are replaced; all others, under any name, and the order of the remaining
    lines, stay, and a page whose lines all go has an empty text. Pages without host or with null text are left as they are
    (a null text has no lines). Repeated rows are pages of their own, unless copies is false, where they count as one;
    frequencies that equal the ratio are not over it. A page of which more than the share most of its characters would go is left
    whole: its lines are what it has in common with near copies, not what a site puts around its pages. Lines and texts may be of any length. An empty table gives an empty one.
    """
    found = Stored(boilerplate(docs, host, text, ratio, min_pages, copies), "boilerplate").df
    size = found.agg(F.coalesce(F.sum(F.size("dropped")), F.lit(0)), F.count("*")).first()
    kept = extra(docs, ("n_lines", "n_dropped"))
    site, dropped, bad, new = (free([*docs.columns, "n_lines", "n_dropped"], x) for x in ("site", "dropped", "bad", "new"))
    found = found.select(F.col("host").alias(site), F.col("dropped").alias(dropped))
    if sum(size) <= BROADCAST_LINES:
        found = F.broadcast(found)
    rows = docs.select(*(F.col(quoted(c)) for c in kept)).join(found, F.col(host) == F.col(site), "left")
    # by hashing, the few boilerplate lines that a page has; then each line is held against those alone
    rows = rows.withColumn(bad, F.array_intersect(_keys(F.col(text)), F.col(dropped)))
    solid = lambda x: _trim(x) != ""
    lines = F.filter(_lines(F.col(text)), lambda x: ~solid(x) | ~F.array_contains(F.col(bad), _key(x)))
    count = lambda t: F.when(t.isNull(), 0).otherwise(F.size(F.filter(_lines(t), solid))).cast("long")
    none = F.coalesce(F.size(bad), F.lit(0)) <= 0
    rows = rows.withColumn(new, F.when(none, F.col(text)).otherwise(F.array_join(lines, "\n"))).withColumn("n_lines", count(F.col(text)))
    if most < 1:
        whole = F.length(new) < (1 - most) * F.length(F.col(text))
        rows = rows.withColumn(new, F.when(whole, F.col(text)).otherwise(F.col(new)))
    rows = rows.withColumn("n_dropped", F.when(none, F.lit(0).cast("long")).otherwise(F.col("n_lines") - count(F.col(new))))
    return rows.select(*(F.col(new).alias(c) if c == text else F.col(quoted(c)) for c in kept), "n_lines", "n_dropped")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_boilerplate(documents(spark, sf_dir))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


OP5_SQL = f"""
with lines as (
  select doc_id, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos, unnest(string_split(text, chr(10))) as line from documents
), solid as (
  select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as bare from lines
), pages as (
  select source, count(*) as n from documents group by source
), bad as (
  select s.source, s.bare from solid s join pages p using (source) where s.bare <> ''
  group by s.source, s.bare, p.n having count(distinct s.doc_id) >= 2 and count(distinct s.doc_id) > {RATIO} * p.n
), marked as (
  select s.*, b.bare is not null as dropped from solid s left join bad b on s.source = b.source and s.bare = b.bare
)
select d.doc_id, coalesce(m.n_lines, 0)::bigint as n_lines, coalesce(m.n_dropped, 0)::bigint as n_dropped,
  case when d.text is not null then sha256(coalesce(m.text, '')) end as text_sha256
from documents d left join (
  select doc_id, count(*) filter (where bare <> '') as n_lines, count(*) filter (where dropped) as n_dropped,
    string_agg(line, chr(10) order by pos) filter (where not dropped) as text
  from marked group by doc_id
) m using (doc_id)
"""
