"""Files in and out, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError
from tessera.sources import readers, sinks
from tessera.streaming import ingest


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"prompt": "p", "chosen": "é"}\n\n{"prompt": null, "chosen": "d"}\n', encoding="utf-8")
    got = readers.scan_jsonl(spark, str(path), "prompt string, chosen string").orderBy("row").collect()
    assert [(r.prompt, r.chosen) for r in got] == [("p", "é"), (None, "d")]
    path.write_text('{"prompt": "p"}\nnot json\n')
    with pytest.raises(Exception, match="not JSON"):
        readers.scan_jsonl(spark, str(path), "prompt string").collect()
    kept = readers.scan_jsonl(spark, str(path), "prompt string", bad="keep")
    assert kept.where("_corrupt is not null").count() == 1


def test_json_csv_parquet(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"x": 1}]}))
    assert readers.scan(spark, str(tmp_path / "a.json"), "x int").count() == 2
    assert readers.scan(spark, str(tmp_path / "b.json"), "x int", "data").first().x == 1
    with pytest.raises(ConfigError):
        readers.scan_json(spark, str(tmp_path / "b.json"), "x int", "rows")
    (tmp_path / "a.csv").write_text('p,c\n"a ""q"" b","two\nlines"\n')
    row = readers.scan(spark, str(tmp_path / "a.csv"), "p string, c string").first()
    assert (row.p, row.c) == ('a "q" b', "two\nlines")
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    assert readers.scan(spark, str(tmp_path / "a.parquet"), "id long").count() == 3
    with pytest.raises(ConfigError):
        readers.scan(spark, "x.txt", "a int")
    assert readers.scan_memory(spark, [{"a": 1}, {"b": "x"}], "a int, b string").count() == 2
    assert readers.file_digests(spark, str(tmp_path / "a.json")).first().length > 0


def test_sinks_and_logs(spark, tmp_path):
    sinks.sink_records(spark.createDataFrame([("é",)], "t string"), str(tmp_path / "out"))
    sinks.sink_append(spark.createDataFrame([("f",)], "t string"), str(tmp_path / "out"))
    assert {r.t for r in spark.read.json(str(tmp_path / "out")).collect()} == {"é", "f"}
    report = sinks.sink_report(spark.createDataFrame([(1, float("nan"))], "n int, x double"), str(tmp_path / "r.json"))
    assert report == {"n": 1, "x": "nan"} == json.loads((tmp_path / "r.json").read_text())
    log = sinks.RunLog(str(tmp_path / "run"))
    log.log(1, loss=0.5)
    log.log(None, accuracy=1.0)
    with pytest.raises(ConfigError):
        sinks.RunLog(str(tmp_path / "run"))
    sinks.RunLog(str(tmp_path / "run"), resume=True).log(1, loss=0.4)
    got = readers.scan_metrics(spark, str(tmp_path / "run/metrics.jsonl")).orderBy("line").collect()
    assert [r.step for r in got] == [1, None, 1] and got[0].metrics == {"loss": "0.5"}
    both = readers.union_files([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "b string")])
    assert both.columns == ["a", "b"] and both.count() == 2


def test_stream_ingest_is_resumed(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "prompt string, chosen string, rejected string"
    for k in range(2):
        (source / f"{k}.json").write_text("".join(json.dumps({"prompt": "p", "chosen": c, "rejected": "r"}) + "\n" for c in ("a", None)))
        q = ingest.ingest(ingest.read_records(spark, str(source), schema), "pairwise", str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "check"))
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == k + 1 and spark.read.parquet(str(tmp_path / "bad")).count() == k + 1


def test_stream_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = ingest.windowed_counts(stream, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    assert ingest.windowed_counts(events, "ts", "event_type", "value").agg(F.sum("n")).first()[0] == events.count()
    assert ingest.sessions(events, "ts", "user_id").agg(F.sum("n")).first()[0] == events.count()


def test_command_line(spark, tmp_path, capsys):
    from tessera import cli
    from tessera import config as C

    path = tmp_path / "pairs.jsonl"
    path.write_text("".join(json.dumps({"prompt": f"p{i % 30}", "chosen": f"a longer answer: {' '.join(f'w{(7 * i + 13 * k) % 50}' for k in range(6 + i % 9))}.", "rejected": f"no x{i % 17} y{i % 11}"}) + "\n" for i in range(120)))
    common = [f"data.train_path={path}", f"out_dir={tmp_path}/runs"]
    common.append("profile.min_pairs=1000")  # no probes of slices here
    for verb in ("audit", "resplit", "profile"):
        assert cli.main([verb, "--set", *common], spark) == 0
    report = json.loads((tmp_path / "runs/run/audit_report.json").read_text())
    assert report["n_groups"] == 120 and report["acc_char_length"] == 1.0 and "trivial_model_wins" in capsys.readouterr().out
    tier1 = json.loads((tmp_path / "runs/run/profile_report.json").read_text())
    assert tier1["health_status"] == "ok" and tier1["shift_status"] == "unavailable" and tier1["frac_isolated"] is not None and "surface_by_construction" in tier1["warnings"]
    sides = [*common, f"data.val_path={path}", "profile.mmd_n_perm=20"]
    for verb in ("profile", "train", "eval"):
        assert cli.main([verb, "--set", *sides], spark) == 0
    tier1 = json.loads((tmp_path / "runs/run/profile_report.json").read_text())
    assert tier1["prompt_overlap_frac"] == 1.0 and tier1["shift_status"] == "not_applicable" and tier1["n_cross"] >= 120 and {"semantic_leakage", "shift_not_meaningful"} <= set(tier1["warnings"])
    assert json.loads((tmp_path / "runs/run/eval_report.json").read_text())["accuracy"] == 1.0
    assert json.loads((tmp_path / "runs/run/train_report.json").read_text())["curve"][0][3] == 0.5
    store = tmp_path / "store"
    store.mkdir()
    assert cli.main(["ledger", "--set", *sides], spark) == 2  # nothing was diagnosed yet
    for verb in ("diagnose", "ledger", "push"):
        assert cli.main([verb, "--set", *sides, f"store={store}"], spark) == 0
    seen = json.loads((tmp_path / "runs/run/diagnose_report.json").read_text())
    assert seen["accuracy"] == 1.0 and seen["n_pairs"] == 120 and abs(seen["cos_w_mean_delta"]) <= 1.0
    rows = json.loads((tmp_path / "runs/run/ledger.json").read_text())
    assert [r["ord"] for r in rows] == list(range(7)) and rows[0]["verdict"] == "confirmed: at the surface ceiling"
    assert rows[5]["verdict"] == "prompts leak" and rows[3]["verdict"] == "spaces are the same: comparable" and "120 pairs" in rows[5]["observed"]
    assert cli.main(["pull", "--set", f"out_dir={tmp_path}/again", f"store={store}"], spark) == 0
    assert (tmp_path / "again/run/ledger.json").read_text() == (tmp_path / "runs/run/ledger.json").read_text()
    for bad in (["store="], [f"store={tmp_path}/none"], [f"store={store}", "run_name=../x"], [f"store={store}", "run_name=absent"]):
        assert cli.main(["pull", "--set", f"out_dir={tmp_path}/again", *bad], spark) == 2 and cli.main(["push", "--set", f"out_dir={tmp_path}/runs", *bad], spark) == 2
    (store / "run/ledger.json").write_text("[]")
    assert cli.main(["pull", "--set", f"out_dir={tmp_path}/again", f"store={store}"], spark) == 2
    assert (tmp_path / "again/run/ledger.json").read_text() != "[]"  # nothing is copied then
    assert cli.main(["train", "--set", *common], spark) == 2 and cli.main(["eval", "--set", *common, "run_name=none"], spark) == 2
    split = json.loads((tmp_path / "runs/run/split_report.json").read_text())
    assert split["n_overlap_prompts"] == 0 and split["n_rows"] == 120
    assert cli.main(["audit"], spark) == 2 and cli.main(["audit", "--set", "data.layoutt=x"], spark) == 2
    (tmp_path / "c.yaml").write_text("split: {val_frac: 0.3}\ndata: {slice_keys: [a, b], layout: arena}\n")
    cfg = C.load(str(tmp_path / "c.yaml"), ["split.method=random", "split.drop_exact_duplicates=yes"])
    assert cfg.split.val_frac == 0.3 and cfg.split.drop_exact_duplicates is True and cfg.data.slice_keys == ("a", "b") and C.flatten(cfg)["split.method"] == "random"
    for bad in ("split.val_frac=x", "data.layout=csv", "nope=1", "x"):
        with pytest.raises(ConfigError):
            C.load(None, [bad])
