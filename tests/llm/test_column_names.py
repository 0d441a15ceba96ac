"""Further columns of any name: with dots, blanks and accents grave, and like those that an operator adds but for their case."""

import corpus_pipeline
import pytest
from tessera.llm import language_id, line_dedup, near_dedup, periodic_runs, pii, quality_mil, quality_rules
from tessera.llm.common import extra

TEXTS = [
    "the quick brown fox jumps over the lazy dog near the river bank while mail goes to ann@example.org today",
    "der schnelle braune Fuchs springt und der Hund schläft neben dem Fluss während die Sonne langsam untergeht",
    None,
    "",
]
ODD = ["a.b", "with blank", "x`y", "Ü.v", "extra"]


def table(spark, clashing=()):
    names = [*ODD, *clashing]
    columns = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{n.replace('`', '``')}` string" for n in names)])
    rows = [(i, t, "ende"[2 * (i % 2) :][:2], "h", 0, *(f"{n} {i}" for n in names)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, columns)


OPERATORS = {
    "op1": (lambda d: language_id.predict(d, language_id.train(d)), ["Lang_Pred", "SCORE"]),
    "op2": (lambda d: quality_mil.score(d, quality_mil.train(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))), ["Score", "Predicted"]),
    "op4": (quality_rules.judge, ["Kept", "N_words"]),
    "op5": (line_dedup.drop_boilerplate, ["N_Lines", "N_DROPPED"]),
    "op10": (pii.find, ["Spans", "N_Email"]),
    "op13": (periodic_runs.find, ["Runs"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_columns_of_any_name_and_replace_their_own_in_any_case(spark, name):
    work, clashing = OPERATORS[name]
    docs = table(spark, clashing)
    found = work(docs)
    lowered = [c.lower() for c in found.columns]
    assert len(set(lowered)) == len(lowered)
    assert [c for c in found.columns if c in docs.columns][: 5 + len(ODD)] == docs.columns[: 5 + len(ODD)]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert set(rows) == set(range(len(TEXTS)))
    assert all(r[c] == f"{c} {i}" for i, r in rows.items() for c in ODD)
    assert work(docs.limit(0)).columns == found.columns and work(docs.limit(0)).count() == 0


def test_near_duplicates_keep_columns_of_any_name(spark):
    docs = table(spark, ["Kept", "Digest"])
    found = near_dedup.deduplicate(docs)
    assert found.columns == docs.columns and found.count() == len(TEXTS)
    assert all(r[c] == f"{c} {r['doc_id']}" for r in found.collect() for c in [*ODD, "Kept", "Digest"])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, sf_dir, name, stage):
    clashing = ["Lang_Pred", "N_Lines", "N_Dropped", "Kept", "Spans", "Score"]
    docs = table(spark, clashing)
    found = stage(spark, docs, sf_dir)
    assert found.columns == docs.columns
    rows = found.collect()
    assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in [*ODD, *clashing])


def test_names_are_told_apart_as_spark_does(spark):
    assert extra(table(spark, ["Kept"]), ["KEPT", "A.B"]) == ["doc_id", "text", "lang", "source", "n_chars", *ODD[1:]]


def test_long_labelled_texts_are_learnt_from(spark):
    """Every labelled text is over SAMPLE_TEXT, and its label shows in no single part of fixed place."""
    good, bad = "A plain sentence that reads well, as sentences do. ", "XX## 99|| $$$ zz%% 11<> && "
    size = 2 * quality_mil.SAMPLE_TEXT
    texts = [(i, ((good if i % 2 else bad) * size)[:size], i % 2) for i in range(40)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality_mil.score(docs, quality_mil.train(docs, labels)).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)
