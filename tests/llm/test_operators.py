"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import fingerprint, huffman, id_files, language_id, line_dedup, near_dedup, packing, pii, prefix_bpe, quality_mil, quality_rules
from tessera.llm.common import documents

BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, node string, bucket string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(*texts, lang="en", source="s"):
    return [(i, t, lang, source, len(t or ""), "x", "y", "z", "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tied, repeated and long texts, nulls in the other columns, and columns that clash."""
    data = rows(None, "", "  \n\t", "one", "one", "Ein Wort. Ünïcödé 12.3.4.5 a@b.de " * 3, "word " * 30_000, "!!! ???", "a b c d e f g h", "a b c d e f g h")
    data += [(11, None, None, None, None, None, None, None, None), (12, "no language or source here", None, None, None, None, None, None, None), (None, "no id", "en", "s", 5, "x", "y", "z", "b")]
    data += [data[3]]  # a row twice
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 ---


def test_suffix_automaton_counts():
    text = "abcbcabcabac"
    code = {c: k + 2 for k, c in enumerate("abc")}
    table, count = language_id.automaton(text, code)
    subs = Counter(text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1))
    for sub, n in subs.items():
        s = 0
        for c in sub:
            s = table[s, code[c]]
        assert s > 0 and count[s] == n
    assert table[table[0, code["a"]], code["a"]] == -1


def brute_parse(text, sample):
    """Phrases that end in a greedy parse of the whole text, and the one that is open at its end."""
    ends, cur = 0, ""
    for c in text:
        if cur + c in sample:
            cur += c
            continue
        ends += cur != ""
        if c in sample:
            cur = c
        else:
            ends, cur = ends + 1, ""
    return ends, cur


def occurrences(sub, text):
    return sum(text.startswith(sub, k) for k in range(len(text)))


def test_cross_parse_is_greedy():
    """Also of texts of many windows, of periodic ones whose parses do not meet, and with the open phrase at the end."""
    rnd = random.Random(2)
    sample = "".join(rnd.choice("abcde ") for _ in range(400)).strip()
    sample = " ".join(sample.split())
    other = "abcde" * 60 + " edcba"
    model = language_id.Model.fit({"x": sample, "y": other})
    w = language_id.WINDOW
    texts = ["".join(rnd.choice("abcdefz ") for _ in range(rnd.randint(1, 200))) for _ in range(40)]
    texts += ["".join(rnd.choice("abcde ") for _ in range(n)) for n in (w - 1, w, w + 1, 2 * w, 5 * w + 7, 3000)]
    texts += ["abcde" * 500, "ab" * 900, sample * 4, sample[3:] + "q" + sample, "a" * (3 * w)]
    bits, letters = model.entropies(texts, model.codes())
    for k, corpus in enumerate((sample, other)):
        for t, b, n in zip(texts, bits[:, k], letters):
            plain = " ".join(t.split()) if t.strip() else ""
            lead = " " if t[:1] == " " and plain else ""
            assert n == sum(c != " " for c in t)
            if plain:
                ends, cur = brute_parse(lead + plain, corpus)
                rest = np.log(len(corpus) / occurrences(cur, corpus)) / np.log(len(corpus)) if cur else 0
                assert b * len(lead + plain) / model.scale[k] == pytest.approx(ends + rest, abs=1e-6)


def test_languages_learnt_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    data = [(10 * i + k, f"text of language {name}", name) for i, name in enumerate("abc") for k in range(3 + i)]
    model = language_id.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert len(model.languages) <= 2 and "c" in model.languages


def test_language_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = language_id.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_cases(spark, odd, none):
    model = language_id.Model.fit({"de": "ein wort und noch ein wort", "en": "a word and one more word in the text"})
    got = language_id.predict(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has) and (has or r.score == 0)
        assert set(odd.columns) <= set(r.asDict())
    assert len({r.lang_pred for r in got if r.text == "one"}) == 1
    assert language_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.train(none)).collect()} == {"und"}


# --- 2 ---


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_mil.op2_quality_mil(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (good >= 0.3).mean() > 0.95 and bad.mean() + 0.3 < good.mean()
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def plain_score(w, bag):
    """One document: tanh encodings, gated attention over its passages, a logistic value of their weighted mean."""
    h = [[np.tanh(sum(x[i] * w["W"][i, k] for i in np.flatnonzero(x)) + w["b"][k]) for k in range(quality_mil.HIDDEN)] for x in bag]
    gate = [[np.tanh(np.dot(e, w["V"][:, j])) / (1 + np.exp(-np.dot(e, w["U"][:, j]))) for j in range(quality_mil.GATE)] for e in h]
    logit = [np.dot(g, w["a"]) for g in gate]
    share = np.exp(np.array(logit) - max(logit))
    mean = (share / share.sum()) @ np.array(h)
    return 1 / (1 + np.exp(-(mean @ w["c"] + w["d"][0])))


def test_quality_gradient():
    rng = np.random.default_rng(0)
    per = np.array([3, 1, 5])
    x = np.where(rng.random((9, quality_mil.WIDTH)) < 0.05, rng.normal(size=(9, quality_mil.WIDTH)), 0)
    y = np.array([1.0, 0.0, 1.0])
    model = quality_mil.Model.fit(x.astype(np.float32), per, y.astype(np.float32))
    p = model.score(x.astype(np.float32), per)
    assert p[0] > 0.5 > p[1] and p[2] > 0.5
    w = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in model.weights.items()}
    model = quality_mil.Model(w)
    p = model.score(x, per)
    assert p == pytest.approx([plain_score(w, bag) for bag in np.split(x, np.cumsum(per)[:-1])], abs=1e-9)
    found = model.gradients(x, per, y)
    loss = lambda: -np.mean(y * np.log(model.score(x, per)) + (1 - y) * np.log(1 - model.score(x, per)))
    for name, g in found.items():
        spots = [np.unravel_index(k, g.shape) for k in (np.argmax(np.abs(g)), *rng.integers(0, g.size, 4))]
        for at in spots:
            old = w[name][at]
            w[name][at] = old + 1e-5
            up = loss()
            w[name][at] = old - 1e-5
            down = loss()
            w[name][at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-7, rel=1e-4), (name, at)


def test_quality_passages():
    """Passages of 64 words: shares of neighbouring classes, words again at once, different words, letters a word."""
    text = b" ".join([b"Aa", b"bb", b"bb", b"9."] * 20)
    x, per = quality_mil.passages([text, b"", b"one"])
    assert per.tolist() == [2, 1, 1] and (x[2] == 0).all()
    first = text.split()[:64]
    assert x[0, 256:259] == pytest.approx([sum(u == v for u, v in zip(first, first[1:])) / 64, len(set(first)) / 64, 0.2])
    kinds = {"a": 0, "A": 1, "9": 2, " ": 3, ".": 5}
    of = lambda c: kinds[chr(c) if chr(c) in kinds else "a"]
    piece = b" ".join(first) + b" A"
    want = Counter(of(u) + 16 * of(v) for u, v in zip(piece, piece[1:]))
    total = sum(want.values())
    assert {k: v**2 for k, v in enumerate(x[0, :256]) if v} == pytest.approx({k: v / total for k, v in want.items()}, abs=1e-6)


def test_quality_cases(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality_mil.train(odd, labels)
    got = quality_mil.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if not (r.text or "").split()}) == 1
    assert quality_mil.score(none, model).count() == 0
    assert {r.score for r in quality_mil.score(odd, quality_mil.train(odd, labels.limit(0))).collect()} == {0.5}


# --- 3 ---


def components(texts, n, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def groups_of_copies(seed, groups=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 10, 60, 150]))]
        for _ in range(rnd.choice([1, 2, 10, 30])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 8))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


#: Each bound that the operator has, so low that what lies beyond it is used: blocks of stragglers, salts, shuffled texts, stars, equal hashes.
BOUNDS = {"as they are": {}, "blocks": {"BLOCK": 4}, "salts": {"HOT_ROWS": 2}, "shuffles": {"BROADCAST_ROWS": 0}, "stars": {"few": 0, "HOT_ROWS": 3}, "hashes": {"bits": 3}, "all": {"BLOCK": 3, "HOT_ROWS": 1, "BROADCAST_ROWS": 0, "few": 0, "bits": 2}}


@pytest.fixture(params=sorted(BOUNDS))
def bounds(request, monkeypatch):
    b = dict(BOUNDS[request.param])
    if "few" in b:
        components = near_dedup.components
        monkeypatch.setattr(near_dedup, "components", lambda links, few=b.pop("few"): components(links, few))
    if "bits" in b:
        signatures = near_dedup.signatures
        monkeypatch.setattr(near_dedup, "signatures", lambda docs, shingle, node_bits=64, bits=b.pop("bits"): signatures(docs, shingle, bits))
    for k, v in b.items():
        monkeypatch.setattr(near_dedup, k, v)
    return request.param


def test_near_duplicates_against_brute_force(spark, bounds):
    texts = groups_of_copies(4)
    want, sizes = components(texts, 2)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows(*texts), SCHEMA), shingle=2).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_complete_pass_finds_what_the_likeliest_pairs_miss(spark, monkeypatch):
    """If none of the stragglers' likeliest pairs is a link, all their likely pairs are still confirmed."""
    texts = groups_of_copies(9, 8)
    want, _ = components(texts, 2)
    confirm, fine = near_dedup._confirm, []

    def emptied(*args, coarse):
        found = confirm(*args, coarse=coarse)
        if not coarse and found is not None:
            fine.append(1)
            return found.limit(0) if len(fine) == 1 else found
        return found

    monkeypatch.setattr(near_dedup, "_confirm", emptied)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows(*texts), SCHEMA), shingle=2).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want


def test_near_duplicates_without_ids(spark):
    """Rows without id link others and are linked; several rows of an id are each compared by themselves."""
    base = [f"v{k}" for k in range(60)]
    near = lambda *at: " ".join("x" + w if k in at else w for k, w in enumerate(base))
    data = [(None, near()), (5, near(0)), (1, near(59, 58, 57)), (7, "other text"), (7, near(1)), (None, "alone"), (None, "alone"), (None, ""), (3, None), (3, "alone too"), (4, "alone too")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, shingle=1).collect()}
    assert got[None, 60] == (1, False) and got[5, 60] == (1, False) and got[1, 60] == (1, True) and got[7, 60] == (1, False) and got[7, 2] == (7, True)
    assert got[None, 1] == (None, True) and got[None, 0] == (None, True) and got[3, 0] == (3, True) and got[3, 2] == (3, True) and got[4, 2] == (3, False)
    # a row without id is the only link of two others
    chain = [(5, " ".join(f"a{k}" for k in range(100))), (None, " ".join(f"a{k}" for k in range(10, 110))), (9, " ".join(f"a{k}" for k in range(20, 120)))]
    assert {r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), shingle=1).collect()} == {5}
    left = near_dedup.deduplicate(docs.withColumn("key", F.lit("k")), shingle=1)
    assert left.columns == ["doc_id", "text", "key"]
    assert sorted(((r.doc_id or -1, r.text or "") for r in left.collect())) == sorted([(1, near(59, 58, 57)), (7, "other text"), (-1, "alone"), (-1, ""), (3, ""), (3, "alone too")])


def test_deduplicate_keeps_one_of_each_component(spark, bounds):
    texts = groups_of_copies(5)
    want, _ = components(texts, 2)
    data = rows(*texts) * 2 + [(0, None, "en", "s", 0, "x", "y", "z", "b")] * 2
    left = near_dedup.deduplicate(spark.createDataFrame(data, SCHEMA).repartition(7), shingle=2).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == sorted([(i, texts[i]) for i in set(want)] + [(0, ""), (0, "")])


def test_near_duplicate_chain(spark):
    """Links that only hold from one text to the next still make one component."""
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(words[k * 8 : k * 8 + 100]) for k in range(30)]
    want, _ = components(texts, 2)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows(*texts), SCHEMA), shingle=2).collect()}
    assert [got[i] for i in range(len(texts))] == want and set(want) == {0}


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 50, 50))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    sizes = np.array([len(s) for s in sets])
    sketches = near_dedup.odd_sketches(near_dedup.minhashes(np.concatenate(sets), sizes, near_dedup.PRECISE_SAMPLES), near_dedup.PRECISE_BITS)
    assert abs(near_dedup.estimate(sketches[:1], sketches[1:], near_dedup.PRECISE_SAMPLES, near_dedup.PRECISE_BITS)[0] - 0.9) < 0.04


def test_near_duplicate_cases(spark, odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].component_id == 0 and by[0][0].n_shingles == 0 and by[0][0].kept  # null and empty texts stay alone
    assert by[1][0].component_id == 1 and by[2][0].component_id == 2
    assert {r.component_id for r in by[3] + by[4]} == {3} and not by[4][0].kept
    assert len(by[3]) == 2 and by[9][0].component_id == 8
    assert by[6][0].n_shingles == 1
    assert near_dedup.near_duplicates(none).count() == 0


# --- 4 ---


def test_quality_rules_base_measures(spark, odd, none):
    got = quality_rules.judge(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = set()
        for k in range(len(w) - 7):
            if windows[tuple(w[k : k + 8])] > 1:
                inside.update(range(k, k + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(none).count() == 0


def test_quality_rules_keep_clean_and_drop_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.op4_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.3


def test_quality_rules_run_no_python(spark, sf_dir):
    plan = quality_rules.op4_quality_rules(spark, sf_dir)._jdf.queryExecution().toString() + line_dedup.op5_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 5 ---


def test_line_dedup(spark):
    head = "the header of the site"
    data = [(i, f"{head}\nline {i}\n\n{head} " if i < 6 else f"other {i}\nline {i}", "en", "a", 0, "x", "y", "z", "b") for i in range(20)]
    data += [(100 + i, f"{head}\nunique {i}", "en", "small", 0, "x", "y", "z", "b") for i in range(3)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(data, SCHEMA), ratio=0.25).collect()}
    assert got[0].text == "line 0\n" and got[0].n_lines == 3 and got[0].n_dropped == 2
    assert got[7].text == "other 7\nline 7" and got[7].n_dropped == 0
    assert got[100].text == "unique 0"  # a host of three pages: the line of all goes, that of one page stays
    assert line_dedup.drop_boilerplate(spark.createDataFrame(data, SCHEMA), ratio=0.25, min_pages=5).where("doc_id = 100").first().n_dropped == 0
    tied = line_dedup.drop_boilerplate(spark.createDataFrame(data, SCHEMA), ratio=0.3).where("doc_id = 0").first()
    assert tied.n_dropped == 0  # 6 of 20 pages are not over 0.3


def test_line_dedup_cases(spark, odd, none):
    got = line_dedup.drop_boilerplate(odd, min_pages=2, ratio=0.1)
    assert got.count() == odd.count() and got.columns[: len(odd.columns)] == odd.columns
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].text is None and by[0].n_lines == 0 and by[3].text == "" and by[3].n_dropped == 1 and by[12].text == "no language or source here"
    assert line_dedup.drop_boilerplate(none).count() == 0


WORKING = ["site", "dropped", "bad", "new", "host", "page", "keys", "line", "id", "n", "pages", "row", "words", "chars", "upper", "digit", "mark", "common", "class_share", "word_share", "part", "r", "top", "lang_", "Row", "_row", "_host", "_dropped", "_lang", "_text", "_words"]


def test_native_operators_keep_columns_of_their_working_names(spark):
    """A column under any name that the operators use inside stays as it is, and changes nothing."""
    plain = spark.createDataFrame([(i, f"the header\nline {i} of the text", "en", "a") for i in range(30)] + [(30, None, None, None)], "doc_id long, text string, lang string, source string")
    names = list({c.lower(): c for c in WORKING}.values())
    wide = plain.select("*", *(F.concat(F.lit(c), "doc_id").alias(c) for c in names))
    for f in (quality_rules.judge, line_dedup.drop_boilerplate):
        want, got = f(plain), f(wide)
        assert set(got.columns) == {*want.columns, *names}
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        assert got.where(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in names)).count() == 0


# --- 6 ---


def plain_fingerprint(data):
    """The definition, byte after byte: the hash of each window of 7 bytes, chunks that end where its low bits are zero."""
    from tessera.llm.common import _BASE, _BYTE

    full, base = (1 << 64) - 1, int(_BASE)

    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & full
        return x ^ (x >> 31)

    def digest(part):
        return mix(sum(int(_BYTE[c]) * pow(base, i, 1 << 64) for i, c in enumerate(part)) & full)

    def zeros(x):
        return 64 if not x else (x & -x).bit_length() - 1

    ends = {i: zeros(digest(data[i - 7 : i])) for i in range(7, len(data) + 1)}
    k = max(2, (max(len(data), 1) - 1).bit_length() - 6)
    while k > 2 and sum(z >= k for z in ends.values()) < 32:
        k -= 1

    def signature(bits):
        cuts = [i for i, z in ends.items() if z >= bits][:63]
        if data and (not cuts or cuts[-1] != len(data)):
            cuts.append(len(data))
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return "".join(alphabet[digest(data[a:b]) >> 58] for a, b in zip([0, *cuts], cuts))

    return f"{k}:{signature(k)}:{signature(k + 1)}"


def test_fingerprint_against_plain_chunks():
    rnd = random.Random(12)
    texts = [b"", b"a", b"abcdef", b"abcdefg", "é ä\n😀".encode(), b"x" * 900, b"".join(b"word%d " % i for i in range(700))]
    texts += [bytes(rnd.choice(b"abcd efgh\n") for _ in range(rnd.choice([5, 60, 300, 2500]))) for _ in range(25)]
    assert fingerprint.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def plain_likeness(x, y):
    def near(a, b):
        if not a and not b:
            return 1.0
        need = min(7, max(1, min(len(a), len(b)) // 4))
        if not any(a[i : i + need] in b for i in range(len(a) - need + 1)) or not a or not b:
            return 0.0
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return 1 - row[-1] / max(len(a), len(b))

    if x == y:
        return 1.0
    (k, x1, x2), (j, y1, y2) = x.split(":"), y.split(":")
    own, other = {int(k): x1, int(k) + 1: x2}, {int(j): y1, int(j) + 1: y2}
    return max([near(own[n], other[n]) for n in own.keys() & other.keys()], default=0.0)


def test_likeness_against_plain_edit_distance():
    rnd = random.Random(13)
    left, right = [], []
    for _ in range(40):
        a = bytes(rnd.choice(b"abcd efgh") for _ in range(rnd.choice([0, 3, 40, 400, 1500])))
        b = bytearray(a) if rnd.random() < 0.8 else bytearray(b"zzz " * rnd.randint(0, 300))
        for _ in range(rnd.choice([0, 1, 5, 30])):
            if b:
                b[rnd.randrange(len(b))] = 120
        left.append(a)
        right.append(bytes(b + a[: rnd.choice([0, 50, 900])]))
    x, y = fingerprint.fingerprints(left), fingerprint.fingerprints(right)
    assert fingerprint.likeness(x, y).tolist() == pytest.approx([plain_likeness(a, b) for a, b in zip(x, y)])


def test_fingerprints(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = fingerprint.edited(odd).collect()
    assert len(got) == len(docs) and fingerprint.edited(none).count() == 0
    by_text = {}
    texts = dict(docs)
    for r in got:
        by_text.setdefault(texts[r.doc_id] or "", set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_neighbours(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc äé\n") for _ in range(rnd.choice([0, 1, 5, 400, 3000]))) for _ in range(60)]
    got = {r.doc_id: r for r in fingerprint.edited(spark.createDataFrame(rows(*texts), SCHEMA)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        following = texts[i - 1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(t)
        prints = fingerprint.fingerprints([t.encode(), changed.encode(), following.encode()])
        assert [got[i].fingerprint, got[i].edited_fingerprint] == prints[:2]
        assert [got[i].near_edited, got[i].near_next] == fingerprint.likeness([prints[0]] * 2, prints[1:]).tolist()


def test_edit_distance_bits():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(5)
    left = ["".join(rnd.choice("ABC") for _ in range(rnd.randint(1, 64))) for _ in range(200)]
    right = [x[: len(x) // 2] + "".join(rnd.choice("ABC") for _ in range(rnd.randint(0, 32))) for x in left]
    for x, y, v in zip(left, right, fingerprint.signature_likeness(left, right)):
        if v:
            assert abs(v - (1 - distance(x, y) / max(len(x), len(y)))) < 1e-12
    local = fingerprint.fingerprints([b"".join(b"word%d " % i for i in range(2000)), b"".join(b"word%d " % (i if i != 1000 else 7) for i in range(2000))])
    assert fingerprint.likeness(local[:1], local[1:])[0] > 0.9


# --- 7 ---


def test_packing(spark, odd, none):
    tokenizer = Tokenizer.from_file(BPE)
    got = packing.pack(odd, BPE).toPandas()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id == r.doc_id].drop_duplicates("piece").sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == packing.CAPACITY).all() and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert (got.doc_id == 3).sum() == 2
    assert len(placed.sequence_id.unique()) == len(best_fit(got.length.tolist(), packing.CAPACITY))
    assert packing.pack(none, BPE).count() == 0


def best_fit(lengths, capacity, gaps=()):
    """Lengths, longest first, one after another into the smallest gap that is large enough, or a new one; what is left of each."""
    left = list(gaps)
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(left) if g >= n]
        if fits:
            left[min(fits)[1]] -= n
        else:
            left.append(capacity - n)
    return left


def test_sweep_is_best_fit():
    rnd = random.Random(8)
    for _ in range(300):
        top = rnd.choice([6, 30, 1024])
        gaps, lengths = (np.array(sorted((rnd.randint(1, top) for _ in range(rnd.randint(0, 60))), reverse=True), np.int64) for _ in range(2))
        into, used, left = packing.sweep(gaps, lengths)
        rest = gaps.copy()
        for n, g, u in zip(lengths, into, used):
            if g >= 0:
                assert u == gaps[g] - rest[g]
                rest[g] -= n
        assert (rest == left).all() and (left >= 0).all()
        # those without a gap fit in none that is left, and sizes are as if one after another was placed
        plain = list(gaps)
        none = 0
        for n in lengths:
            fits = [(x, i) for i, x in enumerate(plain) if x >= n]
            if fits:
                plain[min(fits)[1]] -= n
            else:
                none += 1
        assert sorted(plain) == sorted(left.tolist()) and none == (into < 0).sum()


def test_successors():
    rnd = random.Random(9)
    for _ in range(200):
        ranges, size = [], 1000
        for p in range(rnd.randint(1, 12)):
            longest, size = size, max(1, size - rnd.randint(0, 120))
            ranges.append((p, rnd.choice([0, 0, rnd.randint(1, 50)]), longest, rnd.choice([0, rnd.randint(1, 30)]), size))
        pieces, gaps = {}, {}
        for part, of_gaps, first, end, base, step, each in packing.successors(ranges):
            for r in range(first, end):
                m = base + step * ((r - first) // each)
                if of_gaps:
                    assert m not in gaps and r < ranges[part][3]
                    gaps[m] = part
                else:
                    pieces.setdefault(m, []).append(part)
        assert set(gaps) == set(pieces)
        for m, parts in pieces.items():
            assert len(set(parts)) == 1 and gaps[m] < parts[0] and len(parts) * ranges[parts[0]][2] <= ranges[gaps[m]][4]
        # a piece stays only if no gap above is left
        for part, n, *_ in ranges:
            if sum(x.count(part) for x in pieces.values()) < n:
                assert all(sum(g == q for g in gaps.values()) == ranges[q][3] for q in range(part)) or any(sum(x.count(p) for x in pieces.values()) for p in range(part + 1, len(ranges)))


@pytest.mark.parametrize("capacity,kind,range_rows", [(1024, "mixed", 10**6), (1024, "mixed", 100), (1024, "equal", 50), (37, "mixed", 60), (10, "ones", 200), (1024, "small", 150)])
def test_place_against_best_fit(spark, capacity, kind, range_rows):
    """Every piece once, no overlap, and nearly as few sequences as best fit of one piece after another; equal with one range."""
    rnd = random.Random(capacity)
    draw = {"mixed": lambda: rnd.randint(1, capacity), "equal": lambda: 300, "ones": lambda: 1, "small": lambda: rnd.choice([1, 2, 3, 5, 40, 200, rnd.randint(1, capacity)])}[kind]
    lengths = [draw() for _ in range(900)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    got = packing.place(pieces, capacity, range_rows).df.toPandas()
    assert sorted(got.pid) == list(range(len(lengths)))
    ends = {}
    for r in got.sort_values(["seq", "offset"]).itertuples():
        assert r.offset == ends.get(r.seq, 0)
        ends[r.seq] = r.offset + lengths[r.pid]
    assert max(ends.values()) <= capacity
    want = len(best_fit(lengths, capacity))
    assert len(ends) <= want * 1.02 + 1, (len(ends), want)


# --- 8 ---


@pytest.fixture(scope="module")
def vocabulary():
    return prefix_bpe.Vocabulary(prefix_bpe.read_ranks(MULTI))


def test_prefix_bpe_equals_merging(vocabulary):
    ranks = vocabulary.ranks
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(6)
    tokens = list(ranks)
    for k in range(3000):
        piece = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 4))) if k % 2 else bytes(rnd.choice(b"aeinst ") for _ in range(rnd.randint(1, 40)))
        assert prefix_bpe.encode_piece(vocabulary, piece) == want._core_bpe.encode_single_piece(piece)


def test_prefix_bpe_appends_and_edits(vocabulary):
    rnd = random.Random(7)
    for _ in range(200):
        data = bytes(rnd.choice(b"abcdefghij") for _ in range(rnd.randint(0, 150)))
        grown = prefix_bpe.Prefixes(vocabulary)
        for k in range(0, len(data), 7):
            grown.append(data[k : k + 7])
        whole = prefix_bpe.Prefixes(vocabulary, data)
        assert grown.last == whole.last
        a = rnd.randint(0, len(data))
        b = rnd.randint(a, len(data))
        new = bytes(rnd.choice(b"xyzab") for _ in range(rnd.randint(0, 9)))
        whole.replace(a, b, new)
        assert whole.last == prefix_bpe.Prefixes(vocabulary, data[:a] + new + data[b:]).last


def test_prefix_bpe_rows(spark, odd, none, vocabulary):
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    got = prefix_bpe.encode(odd, MULTI).collect()
    assert len(got) == odd.count()
    for r in got:
        ids = want.encode_ordinary(texts[r.doc_id])
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids) and bytes(r.decoded) == texts[r.doc_id].encode()
    assert prefix_bpe.encode(none, MULTI).count() == 0


# --- 9 ---


def test_huffman_lengths_are_optimal_and_limited():
    import heapq

    rnd = np.random.default_rng(2)
    for n in (1, 2, 3, 40, 700):
        counts = rnd.zipf(1.3, n).clip(max=10**9)
        lengths = huffman.code_lengths(counts)
        assert (lengths > 0).all() and sum(2.0 ** -lengths.astype(float)) <= 1 + 1e-12
        heap = sorted(counts.tolist())
        cost = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        if n > 1 and lengths.max() < huffman.MAX_BITS:
            assert (lengths.astype(np.int64) * counts).sum() == cost
    steep = huffman.code_lengths(np.array([2**k for k in range(40)]))
    assert steep.max() == huffman.MAX_BITS and sum(2.0 ** -steep.astype(float)) <= 1


def test_huffman_round_trip():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rnd.zipf(1.2, n).clip(max=60_000) - 1
        counts = np.bincount(ids, minlength=10)
        lengths = huffman.code_lengths(counts)
        docs = np.array([n // 3, 0, n - n // 3])
        payload = huffman.encode(ids.astype(np.int64), docs, 77, lengths, huffman.canonical(lengths))
        back, sizes, first = huffman.decode(payload, huffman.table(lengths))
        assert back.tolist() == ids.tolist() and sizes.tolist() == docs.tolist() and first == 77


def test_id_files(spark, odd, none, tmp_path):
    tokenizer = Tokenizer.from_file(BPE)
    id_files.write(odd, BPE, f"file://{tmp_path}/a", shard_ids=50)
    got = id_files.digests(id_files.read(spark, f"file://{tmp_path}/a")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda x: (x is not None, x))
    texts, at = {r.doc_id: r.text or "" for r in odd.collect()}, 0
    for r in got:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    id_files.write(none, BPE, f"file://{tmp_path}/b")
    assert id_files.read(spark, f"file://{tmp_path}/b").count() == 0


# --- 10 ---

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
}


def brute_spans(text):
    found = [(m.start(), m.end(), k) for k, (p, ok) in PATTERNS.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_pii_patterns():
    rnd = random.Random(9)
    for _ in range(5000):
        t = "".join(rnd.choice("1245.+- @ab@0( )%é") for _ in range(rnd.randint(0, 50)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("x 4111 1111-11111111 y") == [(2, 20, "card")]


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_viterbi_is_the_best_path(field):
    import itertools

    w = pii.analyse([b'a token = "x1y2z3" and', b"my name is Ada"])
    got, e = field.decode(w), field.emissions(w)
    for s in np.unique(w.sentence):
        at = np.flatnonzero(w.sentence == s)
        score = lambda tags: field.begin[tags[0]] + e[at[0], tags[0]] + sum(field.move[a, b] + e[k, b] for k, a, b in zip(at[1:], tags, tags[1:]))
        assert abs(max(score(t) for t in itertools.product(range(5), repeat=len(at))) - score(tuple(got[at]))) < 1e-3


@pytest.mark.parametrize("n", [127, 128, 129, 256, 257, 700])
def test_viterbi_of_long_sentences(field, n):
    """One path over the whole sentence, also where spans lie over the borders of blocks: against one word after another."""
    rnd = random.Random(n)
    token = hashlib.sha1(b"x").hexdigest()
    plain = [rnd.choice("the and of that in with for name is password: Ada Keller mr token".split()) for _ in range(n)]
    for k in range(0, n, 16):
        plain[k : k + 3] = rnd.choice([["token", "=", f'"{token}"'], ["mr", "Ada", "Keller"], ["name:", "Julia", "Roth"]])
    text = " ".join(plain[:n])
    w = pii.analyse([text.encode(), b"and a short one", (text + " " + text).encode()])
    got, e = field.decode(w), field.emissions(w).astype(np.float64)
    assert len(np.unique(w.sentence)) == 3
    for s in np.unique(w.sentence):
        at = np.flatnonzero(w.sentence == s)
        best = field.begin + e[at[0]]
        for k in at[1:]:
            best = (best[:, None] + field.move).max(axis=0) + e[k]
        own = field.begin[got[at[0]]] + e[at[0], got[at[0]]] + sum(field.move[got[a], got[b]] + e[b, got[b]] for a, b in zip(at, at[1:]))
        assert own == pytest.approx(best.max(), abs=1e-2)
    found = pii.all_spans([text], field)[0][1]
    assert {m.start() for m in re.finditer(token, text)} <= {a for a, _, k in found if k == "secret"}


def test_pii_added_spans(field):
    new = 'the éé token = "%s" is here' % hashlib.sha1(b"new").hexdigest()
    names = "signed by Rita Moreno on the page"
    clean = "Thered on the inging of onder. And there was the rest of ening, that of the ander."
    spans = [s for _, s in pii.all_spans([new, names, clean], field)]
    assert [new[a:b] for a, b, k in spans[0] if k == "secret"] == [hashlib.sha1(b"new").hexdigest()]
    assert [names[a:b] for a, b, _ in spans[1]] == ["Rita Moreno"] and spans[2] == []


#: Lines that the labelled table does not have, each with its spans marked as there.
HELD_OUT = """
my name is [name:Fatima Noor] and i work here
dear [name:Lukas Braun], please find the bill below
signed by [name:Hannah Reed] at the town hall
mr [name:Ivan Petrov] did not answer
mrs [name:Rachel Green] moved away
contact: [name:Akira Sato] in the main office
herr [name:Stefan Vogel] kommt aus der stadt
je m'appelle [name:Élodie Martin] et je suis ici
me llamo [name:Ana Torres] y trabajo en la ciudad
regards, [name:Chris Evans] and the family
password: [secret:Kd93jslQm20x] was on the note
api_key = "[secret:d41d8cd98f00b204e9800998ecf8427e00aa11bb]" in the file
auth_token = "[secret:c4ca4238a0b923820dcc509a6f75849b11223344]" was sent
secret = "[secret:eccbc87e4b5ce2fe28308fd9f2a7baf311223344]" and more
The River Thames flows past Tower Bridge and Canary Wharf.
Step One. Step Two. Open Box. Close Box.
Your password should be long and the token should be fresh.
Lime Juice, Brown Sugar, Fresh Mint, Soda Water
L'été à Nice. Les écoles étaient fermées, étrangement vides.
Der Zug fährt über Köln. Die Äpfel sind reif, öfter süß.
The Prime Minister spoke to the House of Lords on Friday.
Garden Tools | Power Drills | Paint Brushes | Door Handles
Error 404: Page Not Found. Go Back Home.
Every Student Must Read This Before The Exam
"""


def test_pii_held_out_lines(field):
    """Spans that the field finds in lines of its kind that it has not seen."""
    lines = [pii._parse(x) for x in HELD_OUT.strip().splitlines()]
    want = {(i, *s) for i, (_, spans) in enumerate(lines) for s in spans}
    got = {(i, *s) for i, (_, spans) in enumerate(pii.all_spans([t for t, _ in lines], field)) for s in spans if s[2] in pii.ADDED}
    assert len(got & want) >= 0.85 * len(want) and len(got - want) <= 2, (sorted(want - got), sorted(got - want))


def test_pii_names_need_capitals():
    assert [pii._capital(x.encode(), 0) for x in ("Élan", "élan", "Z", "z", "王", "1", "-", "")] == [True, False, True, False, True, False, False, False]


def test_pii_secrets_and_clean_texts(spark, field):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").collect()
    found = pii.all_spans([r.text for r in docs], field)
    missed = wrong = 0
    for r, (base, spans) in zip(docs, found):
        assert base == brute_spans(r.text)
        want = {m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)}
        got = {(a, b) for a, b, k in spans if k in pii.ADDED}
        missed += len(want - got)
        wrong += len(got - want)
    assert missed == 0 and wrong <= 2


def test_pii_rows(spark, odd, none, field):
    got = {r.doc_id: r for r in pii.find(odd, field).collect()}
    assert pii.find(odd, field).count() == odd.count() and pii.find(none, field).count() == 0
    assert got[0].redacted is None and got[0].spans == "" and got[1].redacted == ""
    assert got[5].n_ip == 3 and got[5].n_email == 3 and got[5].redacted.count("[IP]") == 3
    assert pii.redact("abcdef", [(1, 3, "ip"), (2, 4, "card")]) == "a[IP]ef"


@pytest.mark.parametrize("name", ["op1_language_id", "op2_quality_mil", "op3_near_dedup", "op6_fingerprint", "op7_packing", "op8_prefix_bpe", "op9_id_files", "op10_pii"])
def test_queries_return_every_document(spark, sf_dir, name):
    from tessera.llm.queries import QUERIES

    got = QUERIES[name](spark, sf_dir)
    assert got.select("doc_id").distinct().count() == documents(spark, sf_dir).count()


def test_ids_equal_the_library():
    from tessera.llm import bpe_ids

    library, own = Tokenizer.from_file(BPE), bpe_ids.encoder(BPE, public_tokenizers.PATTERN)
    rnd = random.Random(11)
    marks = "ab  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0.,!'sdtremvl019²½éßøɏɐªµº–—…’   日本ا😀́"
    for _ in range(4000):
        t = "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40)))
        assert bpe_ids.encode(own, t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert bpe_ids.encode(own, "a", 2).tolist()[-1] == 2
