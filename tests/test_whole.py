"""That queries do the whole job: nothing is cut from their tables, texts or lists before the operators see them."""

import math
import string
from collections import Counter

import __spark_entry__  # noqa: F401  enters the queries
from tessera.plans.registry import QUERIES

def written(spark, folder, name, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_minimal_pairs_of_whole_texts(spark, tmp_path):
    ends = "night light bright sight cat hat mat bat rain train plain chain stone bone phone tone".split()
    texts = [f"the {a} of it\nso we saw {a}.\nand then the {b}!" if (i + j) % 5 == 0 else f"and so we saw the {a},\nit was {b}." for i, a in enumerate(ends) for j, b in enumerate(ends[: 4 + i % 5])]
    texts += [f"{'long ' * 500}bright,\nit was {'very ' * 10}light.", "one line only", "", "first line\nsecond zebra\n" + "many more words\n" * 200, "a rain\n\n the  plain \n"]
    end = lambda x: (x.lower().translate(str.maketrans("", "", string.punctuation)).split() or [None])[-1]
    lines = [[x.strip() for x in t.split("\n") if x.strip()] for t in texts]
    pool = Counter(end(x[1]) for x in lines if len(x) >= 2)

    def choose(x):
        if len(x) != 2:
            return "not two lines"
        a, b = map(end, x)
        if a == b or a[-2:] != b[-2:]:
            return "no rhyme"
        fits = lambda band: [w for w in pool if abs(math.log2(pool[w]) - math.log2(pool[b])) <= band and w not in (a, b) and w[-2:] != a[-2:]]
        found = fits(1) if len(fits(1)) >= 2 else fits(2)
        if len(found) < 2:
            return "no candidates"
        near = [w for w in sorted(found, key=lambda w: (len(w), w))[:8] if len(w) - len(b) <= 100]
        shared = lambda w: max(n for n in range(min(len(a), len(w)) + 1) if a[len(a) - n :] == w[len(w) - n :])
        return [(w, "3+" if shared(w) >= 3 else str(shared(w)), round((len(b) - len(w)) / 10, 6)) for w in near[:2]]

    want = [choose(x) for x in lines]
    sf = written(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.replacement, r.near_miss, r.gap) for r in QUERIES["build_split"](spark, sf).collect())
    assert got == sorted((i, *p) for i, w in enumerate(want) if isinstance(w, list) for p in w)
    assert len(texts) - 5 in {r[0] for r in got}  # the long couplet
    reasons = {r.reason: r.n for r in QUERIES["minimal_reasons"](spark, sf).collect()}
    assert reasons == Counter(None if isinstance(w, list) else w for w in want) and reasons["not two lines"] > 3
