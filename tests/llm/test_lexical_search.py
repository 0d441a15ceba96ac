"""Lexical search against scores of all documents, its parts, and unlucky inputs. Its query has SQL beside."""

import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import lexical_search
from tessera.llm.common import folder_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, top):
    """item_id, rank, doc_id, score of rows (doc_id, text) for different rows (item_id, text)."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(queries):
        scored = []
        for (doc_id, c), size in zip(counts, sizes):
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def searched(spark, docs, queries, name, top=20, **options):
    folder = folder_of(spark, name)
    schema = "doc_id long, text string, N string, `a.b` string"
    lexical_search.build(spark.createDataFrame([(i, t, "x", "y") for i, t in docs], schema).repartition(3), folder, shard_terms=options.pop("shard_terms", 50))
    asked = spark.createDataFrame(queries, "item_id long, text string")
    return sorted((tuple(r) for r in lexical_search.search(spark, folder, asked, top, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms_and_packed_integers():
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice("aZ09_-.\x00\x1f\x20@[`{~\x7f\x80é中😀") for _ in range(rnd.randint(0, 30)))
        assert [t.decode() for t in lexical_search.terms(text)] == plain_terms(text)
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 2**62, *[rnd.randrange(1 << rnd.randint(1, 60)) for _ in range(500)]])
    data, ends = lexical_search.pack(values)
    assert ends[-1] == len(data) and (lexical_search.unpack(data) == values).all()
    assert (lexical_search.unpack(data[ends[3] : ends[7]]) == values[4:8]).all()
    assert len(lexical_search.unpack(lexical_search.pack(np.zeros(0, np.int64))[0])) == 0


def test_merge_equals_sorting():
    rnd = random.Random(2)
    for _ in range(500):
        n, top = rnd.randint(1, 200), rnd.randint(1, 8)
        lists, total = [], Counter()
        for _ in range(rnd.randint(1, 7)):
            places = sorted(rnd.sample(range(n), rnd.randint(1, n)))
            most = rnd.choice((2, 10, 1000))
            scores = [rnd.randint(0, most) for _ in places]
            lists.append((places, scores, max(scores)))
            total.update(dict(zip(places, scores)))
        expected = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:top]
        assert lexical_search.merge(lists, top) == expected


def test_search_equals_brute_force(spark):
    rnd = random.Random(3)
    words = [f"W{k}" for k in range(40)]
    text = lambda n: " ".join(rnd.choice(words[: rnd.choice((3, 10, 40))]) for _ in range(n))
    docs = [(rnd.randrange(10**12), text(rnd.randint(0, 60))) for _ in range(150)]
    docs += [(5, "w1 w2 W3"), (5, "w1 w2 W3"), (6, "w1 w2 W3"), (None, "w1 w2 W3"), (None, None), (7, ""), (8, "!? \n"), (9, "Ünï ÜNÏ w1"), (10, "w1 " * 3000)]
    queries = [(k, text(rnd.randint(1, 12))) for k in range(12)] + [(20, "w1 w1 w1 w2"), (20, "w1 w1 w1 w2"), (21, None), (22, ""), (23, "nowhere"), (24, "Ünï"), (25, "w1"), (25, "w2"), (None, "w3 w3")]
    expected = {top: brute(docs, queries, top) for top in (20, 3)}
    assert searched(spark, docs, queries, "search-a") == expected[20]
    assert searched(spark, docs, queries, "search-b", shard_terms=1 << 20) == expected[20]
    assert searched(spark, docs, queries, "search-c", top=3, block_terms=7) == expected[3]


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")], "search-d") == []
    assert searched(spark, [(1, "a b")], [], "search-e") == []
    assert searched(spark, [(1, None), (2, " ")], [(1, "a")], "search-f") == []
