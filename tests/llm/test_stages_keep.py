"""Stages of the pipeline that once lost texts: near copies on a small host, and a table without any language."""

import corpus_pipeline
from tessera.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(n):
    shared = [f"sentence number {k} of a page that several pages of one small host have in common" for k in range(10)]
    return ["\n".join([*shared[:5], f"own {i}", *shared[5:]]) for i in range(n)]


def test_near_copies_on_a_small_host_leave_one_whole_text(spark, sf_dir):
    texts = near_copies(6)
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in enumerate(texts)], SCHEMA)
    lines = corpus_pipeline.lines(spark, docs, sf_dir)
    assert {r.doc_id: r.text for r in lines.collect()} == dict(enumerate(texts))
    kept = corpus_pipeline.near_duplicates(spark, lines, sf_dir).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(0, texts[0])]


def test_boilerplate_still_goes(spark, sf_dir):
    own = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(40)]
    texts = [f"Home | About\n{t}\nAll rights reserved." for t in own]
    docs = spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert {r.text for r in corpus_pipeline.lines(spark, docs, sf_dir).collect()} == set(own)


def test_without_the_guard_all_shared_lines_go(spark):
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(near_copies(6))], "doc_id long, text string, source string")
    assert {r.text for r in line_dedup.drop_boilerplate(docs, copies=False).collect()} == {f"own {i}" for i in range(6)}
    rows = line_dedup.drop_boilerplate(docs, copies=False, most=0.5).collect()
    assert {(r.n_lines, r.n_dropped) for r in rows} == {(11, 0)}


def test_a_table_without_languages_keeps_its_texts(spark, sf_dir):
    texts = [f"text number {i} in some language" for i in range(12)] + [None, "", "123 !?", "тест"]
    docs = spark.createDataFrame([(i, t, None, "h", 1) for i, t in enumerate(texts)], SCHEMA)
    got = corpus_pipeline.language(spark, docs, sf_dir)
    assert {r.doc_id for r in got.collect()} == {*range(12), 15} and got.columns == docs.columns
    assert corpus_pipeline.language(spark, docs.limit(0), sf_dir).count() == 0
