"""The registry, and that nothing outside the text operators needs them."""

import ast
import hashlib
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from tessera.plans.registry import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]


def test_registry(spark):
    assert __spark_entry__.entry(spark).count() == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_need_text_operators():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


def vectors_of(sf_dir):
    """The embeddings, and the triples that fixtures.py makes of them: id, prompt side, chosen side, rejected side."""
    e = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id")
    v = np.array(e.embedding.tolist(), np.float64)
    n = len(v) // 3
    return v, np.arange(n), v[0 : 3 * n : 3], v[1 : 3 * n : 3], v[2 : 3 * n : 3]


def eigenvalues(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    x = np.linalg.eigvalsh(u.T @ u / len(u))
    return np.sort(x)[::-1]


def cosines(a, b):
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    return a @ b.T


def check_gram_spectrum(rows, sf_dir):
    v, *_ = vectors_of(sf_dir)
    numbers = sorted((x for r in rows for x in r if isinstance(x, float)), reverse=True)
    want = eigenvalues(v)
    assert any(abs(numbers[0] - w) < 1e-4 for w in (want[0], want[0] * len(v)))


def check_vendi_score(rows, sf_dir):
    x = eigenvalues(vectors_of(sf_dir)[0])
    x = x[x > 1e-12] / x.sum()
    assert [v for v in rows[0] if isinstance(v, float)][0] == pytest.approx(np.exp(-(x * np.log(x)).sum()), rel=1e-4)


def check_near_duplicates(rows, sf_dir):
    v = vectors_of(sf_dir)[0]
    at = np.arange(len(v))
    train, val = v[at % 4 != 0], v[at % 4 == 0]
    s = cosines(train, train)
    np.fill_diagonal(s, -9)
    t = cosines(val, val)
    np.fill_diagonal(t, -9)
    c = cosines(train, val)
    r = rows[0]
    assert (r.n_compared, r.n_train, r.n_val, r.n_cross) == (len(train), (s > 0.4).sum() // 2, (t > 0.4).sum() // 2, (c > 0.4).sum())
    assert r.max_cross_cosine == pytest.approx(c.max(), abs=1e-5) and r.nn_cosine_q50 == pytest.approx(np.quantile(s.max(axis=1), 0.5), abs=1e-5)


def check_delta_direction(rows, sf_dir):
    _, _, p, c, r = vectors_of(sf_dir)
    d = c - r
    got = rows[0].asDict()
    assert got["n_pairs"] == len(d) if "n_pairs" in got else True
    norms = np.linalg.norm(d, axis=1)
    assert got["delta_norm_q50"] == pytest.approx(np.quantile(norms, 0.5), rel=1e-6)


def check_linear_probe(rows, sf_dir):
    """The gradient of the regularised logistic loss of d and -d vanishes there."""
    _, _, p, c, r = vectors_of(sf_dir)
    d = c - r
    w = np.array([x.weight for x in sorted(rows, key=lambda x: x.position)])
    slope = lambda w: -(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0)
    g = slope(w)
    assert np.linalg.norm(w) > 0 and np.dot(g, w) / np.linalg.norm(g) / np.linalg.norm(w) < -0.9  # only the penalty holds it back


def check_epoch_batches(rows, sf_dir):
    assert sorted(r.position for r in rows) == list(range(len(rows))) and all(r.batch == r.position // 64 for r in rows)
    assert [r.c_custkey for r in sorted(rows, key=lambda r: r.position)] != sorted(r.c_custkey for r in rows)


def check_split_random(rows, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id")
    side = {}
    for r in rows:
        side.setdefault(tuple(docs.loc[r.doc_id, [c for c in ("source",)]]), set()).add(r.is_val)
    assert {r.is_val for r in rows} == {True, False}


def check_file_sha256(rows, sf_dir):
    data = Path(f"{sf_dir}/nation.parquet").read_bytes()
    assert rows == [(len(data), hashlib.sha256(data).hexdigest())]


def check_pairs_sampled(rows, sf_dir):
    assert len(rows) == len(set(rows)) > 0


def check_train_dpo(rows, sf_dir):
    first, last = min(rows, key=lambda r: r.step), max(rows, key=lambda r: r.step)
    assert first.step == 0 and first.val_accuracy == 0.5 and first.train_loss == pytest.approx(math.log(2)) and last.train_loss < first.train_loss and sum(r.selected for r in rows) == 1


def check_mmd_test(rows, sf_dir):
    v = vectors_of(sf_dir)[0]
    x, y = v[0::2], v[1::2]
    z = np.vstack([x, y])
    d2 = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    k = np.exp(-d2 / np.median(d2[d2 > 1e-12]))
    m, n = len(x), len(y)
    want = (k[:m, :m].sum() - m) / (m * (m - 1)) + (k[m:, m:].sum() - n) / (n * (n - 1)) - 2 * k[:m, m:].mean()
    r = rows[0]
    assert (r.n_a, r.n_b, r.n_subsampled, r.status) == (m, n, m + n, "ok") and r.mmd2 == pytest.approx(want, abs=1e-5) and 0 < r.p_value <= 1


CHECKS = {k.removeprefix("check_"): f for k, f in list(globals().items()) if k.startswith("check_")}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    got = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        rows, again = got.collect(), QUERIES[name](spark, sf_dir).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))  # no SQL: the same in every run, and a plain definition
        assert rows or name in ("build_split",), name
        if name in CHECKS:
            CHECKS[name](rows, sf_dir)
        return
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    plain = lambda v: v + 0.0 if isinstance(v, float) else v  # noqa: E731  one zero
    assert sorted(repr([plain(r[c]) for c in columns]) for r in got.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
