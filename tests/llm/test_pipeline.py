"""The pipeline's stages on their inputs, and on rows with nulls, repeated rows and empty tables."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import near_dedup
from tessera.llm.common import documents


def test_stages_in_order(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns = docs.columns
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir).checkpoint()
        if k < 4:
            assert out.columns == columns
            assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        if k == 2:
            assert near_dedup.near_duplicates(out).where("not kept").count() == 0
        if k == 3:
            assert out.where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
        docs = out
        counts.append(out.select("doc_id").distinct().count())
    assert counts[0] >= counts[1] == counts[2] > counts[3] == counts[4] == counts[5]
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_stages_on_odd_rows(spark, sf_dir):
    schema = documents(spark, sf_dir).schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the word and the text of it", None, None, 27), (3, "the word and the text of it", None, None, 27), (4, "12 34", "en", "a", 5), (5, "a text of its own in the language", "en", "a", 33)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).checkpoint()
    assert {r.doc_id for r in docs.collect()} == {3, 5}
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir).checkpoint()
        assert empty.count() == 0


# --- each stage, and the whole, against plain definitions ---

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture_docs(spark, sf_dir):
    """Whole documents of all kinds, and rows made for each stage; columns under names that operators use inside."""
    base = documents(spark, sf_dir)
    rows = [tuple(r) for r in base.orderBy("doc_id").limit(120).collect()]
    text = next(r[1] for r in rows if r[2] == "en" and len(WORD.findall(r[1])) > 60 and "@" not in r[1])
    words = text.split(" ")
    made = [(1000, None, "en", "made", None), (1001, "12 34 !!", "en", "made", 8), (1002, "жук и дом за рекой " * 20, None, "made", None), (1003, text, "en", "made", 0), (1003, text + " mail a.b@example.org now", "en", "made", 0), (None, text, "en", "made", 0)]
    made += [(1010 + k, "the menu of the site\n" + " ".join(words[k:]) + f"\nand the end number {k} of 10.1.2.{k}", "en", "made", 0) for k in range(20)]
    made += [(1040, "the word and the text of the very long one " * 4000, "en", "other", None)]
    schema = base.schema
    return spark.createDataFrame(rows + made, schema)


def plain_language(docs):
    from tessera.llm import language_id

    model = language_id.train(docs)
    out = []
    for r in docs.collect():
        text = language_id.normalise(r.text or "")
        if not text:
            continue
        best = None
        for k, name in enumerate(model.languages):
            bits = model.entropies([r.text], model.codes())[0][0, k]
            if best is None or bits < best[0]:
                best = (bits, name)
        if best and best[0] <= corpus_pipeline.FOREIGN_BITS:
            out.append((r.doc_id, r.text, best[1]))
    return out


def plain_lines(rows):
    pages = defaultdict(set)
    for r in rows:
        if r.source is not None:
            pages[r.source].add(r.text)
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    bad = {}
    for host, texts in pages.items():
        n = Counter(x for t in texts if t is not None for x in {bare(x) for x in t.split("\n")} if x)
        bad[host] = {x for x, k in n.items() if k >= 2 and k > 0.08 * len(texts)}
    return [(r.doc_id, r.text if r.text is None else "\n".join(x for x in r.text.split("\n") if bare(x) not in bad.get(r.source, ()))) for r in rows]


def plain_components(rows):
    sets = []
    for r in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j]) if sets[i] and sets[j] and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) else 0
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i) if sets[i] else -1 - i].append(i)
    return groups


def test_stages_against_plain_definitions(spark, sf_dir):
    docs = fixture_docs(spark, sf_dir).checkpoint()
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language ID"](spark, docs, sf_dir).checkpoint()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.text, r.lang) for r in one.collect()), key=key) == sorted(plain_language(docs), key=key)
    assert one.where("doc_id in (1000, 1001)").count() == 0
    two = stages["line dedup"](spark, one, sf_dir).checkpoint()
    assert sorted(((r.doc_id, r.text) for r in two.collect()), key=key) == sorted(plain_lines(one.collect()), key=key)
    assert two.where("text like '%the menu of the site%'").count() == 0 < one.where("text like '%the menu of the site%'").count()
    three = stages["MinHash near-dedup"](spark, two, sf_dir).checkpoint()
    rows, left = two.collect(), Counter((r.doc_id, r.text) for r in three.collect())
    for members in plain_components(rows).values():
        least = min((rows[i].doc_id for i in members if rows[i].doc_id is not None), default=None)
        of = [(rows[i].doc_id, rows[i].text) for i in members]
        assert sum(left[x] for x in set(of)) == 1 and any(left[x] and x[0] == least for x in of), of
    assert sum(left.values()) == len(plain_components(rows)) < len(rows)
    four = stages["PII"](spark, three, sf_dir).checkpoint()
    plain = {"EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "IP": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    before = {(r.doc_id, WORD.findall(r.text or "")[:3][0] if WORD.findall(r.text or "") else ""): r.text for r in three.collect()}
    assert four.count() == three.count() and four.where("n_chars <> length(text)").count() == 0
    for r in four.collect():
        for kind, pattern in plain.items():
            assert all(kind == "IP" and any(int(p) > 255 for p in m[0].split(".")) for m in re.finditer(pattern, r.text or "")), r.doc_id
    assert sum(len(re.findall(plain["EMAIL"], t or "")) for t in before.values()) <= four.selectExpr("sum(size(split(text, '.EMAIL.')) - 1)").first()[0]
    five = stages["best-fit packing"](spark, four, sf_dir).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in four.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((None if d != d else int(d), *x) for d, *x in five[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    for _, own in five.sort_values("offset").groupby("sequence_id"):
        assert (own.length.cumsum() - own.length == own.offset).all() and own.length.sum() <= 1024
    assert five.sequence_id.nunique() <= -(-five.length.sum() // 1024) * 1.05 + 1


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    docs = documents(spark, sf_dir).where("doc_id < 60")
    names = ["score", "host", "site", "keys", "page", "node", "kept", "stays", "digest", "key", "noid", "row", "spans", "redacted", "lang_pred", "n_lines", "bad", "new", "lengths"]
    wide = docs.select("*", *(F.concat(F.lit(c), "doc_id").alias(c) for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, docs, sf_dir), stage(spark, wide, sf_dir).checkpoint()
        assert got.columns == wide.columns, name
        assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, want.collect())), name
        assert got.dtypes == wide.dtypes and got.where(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in names)).count() == 0, name
        docs, wide = want.checkpoint(), got
