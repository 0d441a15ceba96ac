"""The store of vectors, caches of reference log-probabilities, and the token model that fills one."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, ContractError, DataError
from tessera.operators import unigram
from tessera.sources import stores


def place(spark, tmp_path, name):
    return f"file://{tmp_path}/{name}"


def encoder(seen):
    def encode(missing):
        seen.append(sorted(r.text for r in missing.collect()))
        return missing.select("sha", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))

    return encode


def test_second_run_encodes_only_new_texts(spark, tmp_path):
    folder, seen = place(spark, tmp_path, "v"), []
    texts = lambda *t: spark.createDataFrame([(k, x) for k, x in enumerate(t)], "id long, text string")
    store = stores.VectorStore(spark, folder, "lengths", buckets=4)
    first = store.embed(texts("a", "bb", "bb", None), "text", encoder(seen)).orderBy("id").collect()
    assert [r.vector for r in first] == [[1, 1], [2, 1], [2, 1], [0, 1]] and [r.text for r in first] == ["a", "bb", "bb", None]
    again = stores.VectorStore(spark, folder, "lengths", buckets=99)  # another run; buckets are the store's
    second = again.embed(texts("bb", "ccc", "", "a"), "text", encoder(seen)).orderBy("id").collect()
    assert [r.vector for r in second] == [[2, 1], [3, 1], [0, 1], [1, 1]]
    assert seen == [["", "a", "bb"], ["ccc"]] and again.buckets == 4
    with pytest.raises(ContractError, match="lengths"):
        stores.VectorStore(spark, folder, "other")
    assert store.embed(texts(), "text", encoder(seen)).count() == 0


def test_rows_that_are_there_twice_count_once_and_go_with_compaction(spark, tmp_path):
    store = stores.VectorStore(spark, place(spark, tmp_path, "w"), "e", buckets=3)
    rows = spark.createDataFrame([(str(k), [float(k)]) for k in range(20)], stores.VectorStore.SCHEMA)
    store.put(rows.union(rows))
    rows.limit(5).write.insertInto(store._table(0))  # as a second run would at the same moment
    spark.catalog.refreshTable(store._table(0))
    assert spark.table(store._table(0)).count() == 25 and store.rows().count() == 20
    assert store.compact() == 1
    assert spark.table(store._table(1)).count() == 20 == store.rows().count()
    store.put(rows.union(spark.createDataFrame([("new", [0.5])], stores.VectorStore.SCHEMA)))
    assert store.compact() == 2 and store.rows().count() == 21
    assert [n for n in store.files.names(store.folder) if n.startswith("generation")] == ["generation-000001", "generation-000002"]
    assert {r.sha: r.vector for r in store.get(spark.createDataFrame([("3",), ("new",), ("none",)], "sha string")).collect()} == {"3": [3.0], "new": [0.5]}


def test_lookups_do_not_shuffle_the_store(spark, tmp_path):
    store = stores.VectorStore(spark, place(spark, tmp_path, "x"), "e", buckets=4)
    store.put(spark.range(500).select(F.col("id").cast("string").alias("sha"), F.array(F.lit(1.0)).alias("vector")))
    plan = store.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def cache_rows(spark, n=5):
    return spark.range(n).select(F.col("id").alias("uid"), (-F.col("id") * 1.5).alias("chosen"), (-F.col("id") - 1.0).alias("rejected"))


def test_a_cache_is_whole_and_refused_by_another_run(spark, tmp_path):
    path, header = place(spark, tmp_path, "cache"), {"fingerprint": "f", "data_digest": "d", "length_norm": "sum"}
    with pytest.raises(DataError, match="no cache"):
        stores.read_cache(spark, path, header)
    with pytest.raises(ConfigError, match="data_digest"):
        stores.publish_cache(cache_rows(spark), path, header | {"data_digest": ""})
    stores.publish_cache(cache_rows(spark), path, header)
    assert stores.read_cache(spark, path, header).count() == 5
    for name in header:
        with pytest.raises(ContractError, match=name):
            stores.read_cache(spark, path, header | {name: "other"})
    stores.publish_cache(cache_rows(spark, 3), path, header)  # the same run again: what is there stays
    assert stores.read_cache(spark, path, header).count() == 5
    with pytest.raises(ContractError, match="fingerprint"):
        stores.publish_cache(cache_rows(spark), path, header | {"fingerprint": "g"})
    assert [p.name for p in tmp_path.iterdir()] == ["cache"]  # nothing half made stays
    cache_rows(spark, 1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(DataError, match="5 rows"):
        stores.read_cache(spark, path, header)


def test_reference_is_made_once_and_refused_after_one_changed_pair(spark, tmp_path):
    path = place(spark, tmp_path, "ref")
    pairs = spark.createDataFrame([(1, "p", "a a b", "c"), (2, "p", "b", ""), (3, "q", "zz", "a")], "pair_uid long, prompt string, chosen string, rejected string")
    model = unigram.fit(pairs, "chosen")
    calls = []

    def score(rows):
        calls.append(1)
        return unigram.score_pairs(rows, model)

    first = stores.make_reference(pairs, path, score, "f").orderBy("pair_uid").collect()
    second = stores.make_reference(pairs, path, score, "f").orderBy("pair_uid").collect()
    assert first == second and len(calls) == 1 and first[1].ref_rejected == 0.0
    changed = pairs.withColumn("chosen", F.when(F.col("pair_uid") == 2, "bb").otherwise(F.col("chosen")))
    with pytest.raises(ContractError, match="data_digest"):
        stores.make_reference(changed, path, score, "f")
    with pytest.raises(ContractError, match="fingerprint"):
        stores.make_reference(pairs, path, score, "g")


@pytest.mark.parametrize("norm", ["sum", "mean"])
def test_token_model_equals_a_plain_one(spark, norm):
    texts = ["The cat, the dog\nand I", "", None, "cat's cat"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in unigram.logprob(rows.withColumn("text", F.concat("text", F.lit(" unseen"))), "id", "text", unigram.fit(rows, "text"), norm).collect()}
    split = lambda t: [x for x in re.findall(r"[a-z0-9']+|\n", (t or "").lower())]
    counts = Counter(w for t in texts for w in split(t))
    n, kinds = sum(counts.values()), len(counts)
    for k, t in enumerate(texts):
        words = [] if t is None else split(t + " unseen")
        want = sum(math.log((counts[w] + 1) / (n + kinds + 1)) for w in words)
        assert got[k].logp == pytest.approx(want / max(len(words), 1) if norm == "mean" else want) and got[k].n_tokens == len(words)


