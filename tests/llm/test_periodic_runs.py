"""Periodic runs against a search over all periods, and the query against a plain definition."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import periodic_runs
from tessera.llm.common import documents


def brute(words):
    """start, length, period of every run, by trying all periods at all places; of equal intervals the least period stays."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                if j + q - i >= max(12, 2 * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(words, doc_id):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def stretches(rnd):
    """Words with runs of all kinds: nested, touching, overlapping, nearly periodic, and none."""
    out = []
    for _ in range(rnd.randint(1, 6)):
        kind = rnd.random()
        unit = [rnd.choice("abcde") for _ in range(rnd.randint(1, 9))]
        if kind < 0.6:
            part = unit * rnd.randint(1, 9)
            part = part[: rnd.randint(1, len(part))]
            if kind < 0.2:
                part[rnd.randrange(len(part))] = "x"
            out += part * rnd.randint(1, 2)
        else:
            out += [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30))]
    return out


def test_z_function():
    rnd = random.Random(1)
    for _ in range(300):
        s = [rnd.randint(0, 2) for _ in range(rnd.randint(0, 30))]
        assert periodic_runs.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_runs_equal_brute_force():
    rnd = random.Random(2)
    cases = [stretches(rnd) for _ in range(1500)] + [["a"] * n for n in (0, 1, 11, 12, 13, 200)] + [list("ab" * 50), list("abcabcabcabca"), [str(i) for i in range(100)] * 2]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    cases.append(list(fibonacci[-1]))
    some = 0
    for words in cases:
        expected = brute(words)
        some += bool(expected)
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        assert periodic_runs.runs_of([number[w] for w in words]) == expected
    # and all texts in one batch, through the stretches
    found, collapsed = periodic_runs.analyse([" ".join(w).encode() for w in cases])
    assert found == [brute(w) for w in cases]
    assert [c.decode().split() for c in collapsed] == [collapse(w, brute(w)) for w in cases]
    assert some > 500


def test_texts_in_one_batch_do_not_mix():
    unit = "one two three four five six"
    texts = [unit, unit, f"{unit} {unit}", f"x {unit}", unit]
    found, _ = periodic_runs.analyse([t.encode() for t in texts])
    assert found == [[], [], [(0, 12, 6)], [], []]


def test_ordinary_text_has_no_stretch():
    rnd = random.Random(3)
    words = [str(rnd.randint(0, 5000)) for _ in range(3000)]
    text = " ".join(words + words[:200] + ["end"] * 11 + words[:200])  # a passage again, too far off for a run
    _, kept = periodic_runs.analyse([text.encode()])
    assert kept == [text.encode()] and brute(text.split()) == []


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_a_plain_definition(spark, name):
    sf = f"/root/testdata/{name}"
    got = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    assert got.keys() == texts.keys()
    with_runs = 0
    for doc_id, text in texts.items():
        words = planted((text or "").encode().split(), doc_id)
        if len(words) > 3000 and name != "sf0.001":
            continue  # the plain definition takes the square of the words
        runs = brute(words)
        with_runs += bool(runs)
        r = got[doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()
    assert with_runs > len(texts) // 20


def test_cases(spark):
    long = "la " * 40_000
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " \n\t", None, None), (4, long, "x", 1), (4, long, "x", 1), (None, "b " * 12, "x", 1), (5, "b " * 11, "x", 1), (6, "Ünï çø  x " * 6, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string, `a.b` long")
    got = periodic_runs.find(docs)
    assert got.columns == ["doc_id", "text", "a.b", "runs", "collapsed"]
    found = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted(found, key=str) == sorted(
        [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 40_000, 1)], "la"), (4, [(0, 40_000, 1)], "la"), (None, [(0, 12, 1)], "b"), (5, [], "b " * 10 + "b"), (6, [(0, 12, 2)], "Ünï çø  x")], key=str
    )
    assert periodic_runs.find(docs.limit(0)).count() == 0
    assert {r["a.b"] for r in got.collect()} == {1, None}
    assert [r.text for r in periodic_runs.plant(docs).where("doc_id is null").collect()] == ["b " * 12]
