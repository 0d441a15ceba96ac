"""The verb resplit loses no record: duplicates are equal in all columns of the records, in every format."""

import json

import pytest

from tessera import cli


def run(spark, tmp_path, path, *more):
    args = ["resplit", "--set", f"data.train_path={path}", f"out_dir={tmp_path}/runs", "split.val_frac=0.3", *more]
    assert cli.main(args, spark) == 0
    rows = [json.loads(line) for name in ("train", "val") for f in (tmp_path / "runs/run" / name).glob("part-*") for line in f.read_text().splitlines()]
    report = json.loads((tmp_path / "runs/run/split_report.json").read_text())
    return rows, report


RECORDS = [{"prompt": f"p{k}", "chosen": "yes", "rejected": "no"} for k in range(40)]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "jsonl"])
@pytest.mark.parametrize("drop", ["true", "false"])
def test_equal_answers_to_different_prompts_stay(spark, tmp_path, kind, drop):
    records = [*RECORDS, *RECORDS[:7]]
    path = tmp_path / f"records.{kind}"
    if kind == "parquet":
        spark.createDataFrame(records, "prompt string, chosen string, rejected string").repartition(3).write.parquet(str(path))
    elif kind == "csv":
        path.write_text("prompt,chosen,rejected\n" + "".join(f"{r['prompt']},yes,no\n" for r in records))
    elif kind == "json":
        path.write_text(json.dumps(records))
    else:
        path.write_text("".join(json.dumps(r) + "\n" for r in records))
    rows, report = run(spark, tmp_path, path, f"split.drop_exact_duplicates={drop}")
    expected = RECORDS if drop == "true" else records
    key = lambda r: sorted(r.items())
    assert sorted(rows, key=key) == sorted(expected, key=key)
    assert report["n_prompts"] == 40 and report["n_exact_duplicate_rows"] == (0 if drop == "true" else 7)


def test_copies_in_other_files_are_copies(spark, tmp_path):
    folder = tmp_path / "many.jsonl"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in RECORDS[:20]))
    rows, _ = run(spark, tmp_path, folder, "split.drop_exact_duplicates=true")
    assert len(rows) == 20 and len({r["prompt"] for r in rows}) == 20
