"""A corpus from raw documents to packed sequences: language, boilerplate, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next. All
but the last return the columns of documents, further ones under any name unchanged; where a stage changes a text, n_chars
follows it. Empty tables pass through; null texts go with the first stage; repeated rows and ties are as each operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_dedup, near_dedup, packing, pii
from tessera.llm.common import Stored, documents, free, quoted

#: Bits a letter from which a text is in none of the languages learnt; texts of those take up to about 6.
FOREIGN_BITS = 8.0
#: Share of a text's characters that may go as boilerplate lines; beyond it the text is left whole, for near duplicates to find.
BOILERPLATE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null ones too) and texts in no language learnt; lang becomes the prediction.

    Where no text has a language to learn from, nothing can be foreign: texts with letters stay, and lang as it is.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = _names(docs, {"lang_pred", "score", "bits_per_letter"})
    rows = language_id.predict(docs.withColumnsRenamed(names), model)
    rows = rows.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits_per_letter") <= FOREIGN_BITS))
    return _back(rows, names, lang=F.col("lang_pred"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that are boilerplate of their source out of the texts; no document goes. Copies of a page count once, and texts
    that would lose more than half of their characters stay whole, so that groups of copies and near copies are there for the next
    stage to find."""
    names = _names(docs, {"n_lines", "n_dropped"})
    return _back(line_dedup.drop_boilerplate(docs.withColumnsRenamed(names), copies=False, most=BOILERPLATE), names, n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one row stays, that with the least id."""
    return near_dedup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each span of personal data in its place; no document goes."""
    names = _names(docs, set(pii.NEW))
    rows = pii.find(docs.withColumnsRenamed(names)).withColumn("text", F.col("redacted"))
    return _back(rows, names, n_chars=F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _names(docs: DataFrame, new: set[str]) -> dict[str, str]:
    """For each column of docs, the name that it has beside the columns that an operator adds under the names new."""
    taken = {x.lower() for x in new}
    return {c: free([*docs.columns, *new], c) if c.lower() in taken else c for c in docs.columns}


def _back(rows: DataFrame, names: dict[str, str], **values: Column) -> DataFrame:
    """The columns of docs again, in their order, some of them with new values."""
    return rows.select(*(values.get(c, F.col(quoted(name))).alias(c) for c, name in names.items()))


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("PII", personal_data), ("best-fit packing", pack)]

#: SQL has no trained models or tokenizers; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before: Stored | None = None
    for name, stage in STAGES[:-1]:
        after = Stored(stage(spark, docs, sf_dir), "stage")
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
