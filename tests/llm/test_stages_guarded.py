"""The line stage with its bound on what a page may lose, and the stage after it, held against plain definitions.

test_pipeline.py states the line stage without that bound.
"""

from collections import Counter

import corpus_pipeline
from test_pipeline import fixture_docs, plain_components, plain_lines


def guarded(rows):
    """Boilerplate lines go, except from a text that would lose more than the share BOILERPLATE of its characters."""
    cut = [text for _, text in plain_lines(rows)]
    keep = 1 - corpus_pipeline.BOILERPLATE
    return [(r.doc_id, r.text if r.text is not None and len(t) < keep * len(r.text) else t) for r, t in zip(rows, cut)]


def test_lines_and_near_duplicates_against_plain_definitions(spark, sf_dir):
    one = corpus_pipeline.language(spark, fixture_docs(spark, sf_dir), sf_dir).checkpoint()
    two = corpus_pipeline.lines(spark, one, sf_dir).checkpoint()
    given, rows = one.collect(), two.collect()
    want = guarded(given)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(want)
    changed = sum(r.text != t for r, (_, t) in zip(given, want))
    whole = sum(r.text == t != p for r, (_, t), (_, p) in zip(given, want, plain_lines(given)))
    assert changed and whole, "the fixture has pages on both sides of the bound"
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, two, sf_dir).collect())
    groups = plain_components(rows)
    for members in groups.values():
        least = min((rows[i].doc_id for i in members if rows[i].doc_id is not None), default=None)
        of = {(rows[i].doc_id, rows[i].text) for i in members}
        assert sum(left[x] for x in of) == 1 and any(left[x] and x[0] == least for x in of), of
    assert sum(left.values()) == len(groups) < len(rows)
