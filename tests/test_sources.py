import json
import os
import subprocess

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tessella.sources import files, git, snapshots
from tessella.streaming import append


def test_mixed_load(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x long, y string").write.parquet(f"{tmp_path}/one.parquet")
    (tmp_path / "two.jsonl").write_text('{"x": 2, "z": "é"}\n')
    (tmp_path / "three.csv").write_text("x")
    out = files.load_results(spark, [f"{tmp_path}/*"]).collect()
    assert {(r.x, r.y, r.z) for r in out} == {(1, "a", None), (2, None, "é")}
    assert files.load_results(spark, f"{tmp_path}/none*", "x long").count() == 0
    with pytest.raises(ValueError):
        files.load_one(spark, f"{tmp_path}/three.csv")
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.load_one(spark, f"{tmp_path}/bad.jsonl", "x long").collect()


def test_save(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "é"), (2, "b", "x")], "x long, y string, z string")
    files.save(df, f"{tmp_path}/out", "jsonl")
    text = "".join((tmp_path / "out" / f).read_text() for f in os.listdir(tmp_path / "out") if f.startswith("part"))
    assert '"y":null' in text and "é" in text
    files.save(df, f"{tmp_path}/by", "json", partition_by=["x"])
    assert (tmp_path / "by" / "x=1").is_dir()
    with pytest.raises(ValueError):
        files.save(df, f"{tmp_path}/out.csv")
    stats = spark.createDataFrame([(1, 2, 3, 4)], "initial_commits bigint, commit_parent_pairs bigint, file_changes bigint, final_file_changes bigint")
    files.save_with_stats(df, stats, f"{tmp_path}/t.parquet")
    assert tuple(files.expansion_stats(spark, f"{tmp_path}/t.parquet").first()) == (1, 2, 3, 4)
    assert tuple(files.expansion_stats(spark, f"{tmp_path}/u.parquet").first()) == (1, 1, 1, 1)


def test_small_documents(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for c in "ab":
        (tmp_path / "s" / f"{c}.json").write_text(json.dumps({"commit_id": c, "status": "ready"}, indent=1))
    assert {r.commit_id for r in files.commit_statuses(spark, f"{tmp_path}/s").collect()} == {"a", "b"}
    (tmp_path / "arr.json").write_text(json.dumps([{"name": str(i)} for i in range(15)]))
    assert files.json_array(spark, f"{tmp_path}/arr.json", "name string").count() == 10
    log = spark.createDataFrame([("1", "t", "m", None, "p", "c", 7, "2024-01-01"), ("2", "t", "m", None, "p", "c", 8, "2024-01-01"), ("3", "t", "m", None, "p", "c", 7, "2024-01-02")], "id string, timestamp string, model_name string, system_prompt string, prompt string, completion string, thread_id bigint, day string")
    files.append_chat(log, f"{tmp_path}/chat")
    assert [r.id for r in files.chat_history(spark, f"{tmp_path}/chat", "2024-01-01", 7).collect()] == ["1"]
    assert files.latest_folder(spark, f"{tmp_path}/none*") is None and files.latest_folder(spark, f"{tmp_path}/*")
    assert files.toolchains(spark.createDataFrame([(" a\n",), ("a",), ("",)], "toolchain_content string")).count() == 1
    with pytest.raises(PySparkException):
        files.verify_groups(spark.createDataFrame([("h", None)], "commit_hash string, code string")).collect()


def test_config():
    base = {"a": {"x": 1, "y": 2}, "b": 1}
    assert files.merge_config(base, files.load_config('{"a": {"y": 3}, "c": 4}')) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4} and base["a"]["y"] == 2


def test_snapshots(spark, tmp_path):
    rows = [("c1", "a/é", "ab" * 32, "regular"), ("c1", "b", "cd" * 32, "symlink"), ("c2", "a", "ef" * 32, "regular")]
    binary = snapshots.to_binary(spark.createDataFrame(rows, "commit_id string, rel_path string, hash string, type string")).collect()
    for r in binary:
        (tmp_path / f"{r.commit_id}.snap").write_bytes(r.content)
    assert sorted(tuple(r) for r in snapshots.read_snapshots(spark, f"{tmp_path}/*.snap").collect()) == rows
    data = snapshots.encode([(p, h, k) for _, p, h, k in rows[:2]])
    assert len(snapshots.decode(data[:-1])) == 1 and snapshots.decode(b"") == []


def test_git_history(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    run("init", "-q")
    for step, text in enumerate(("def a := 1\n", "def a := 1\ndef b := 2\n")):
        (tmp_path / "A.lean").write_text(text)
        run("add", ".")
        run("commit", "-qm", f"feat(A/B): step {step}")
    run("mv", "A.lean", "B.lean")
    (tmp_path / "C.lean").write_bytes(b"\xff new file with text\n")
    run("add", ".")
    run("commit", "-qm", "chore.")
    git.register(spark)
    out = {(r.file_path_before, r.file_path_after): r for r in spark.read.format("githistory").option("repo", str(tmp_path)).option("batch", "2").load().collect()}
    assert set(out) == {("A.lean", "A.lean"), ("A.lean", "B.lean"), (None, "C.lean")}
    first = out["A.lean", "A.lean"]
    assert first.content_after == "def a := 1\ndef b := 2\n" and "+def b := 2" in first.gold_diff and first.author == "A <a@b>" and first.message == "feat(A/B): step 1"
    assert out[None, "C.lean"].content_after.startswith("�")


def test_stream_appends_each_row_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": 1, "x": "a"}\n{"id": 2, "x": "b"}\n')
    go = lambda: append.process_new_files(spark, f"{tmp_path}/in", "id long, x string", lambda d: d.selectExpr("id", "upper(x) x"), "id", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    go()
    (tmp_path / "in" / "2.json").write_text('{"id": 2, "x": "again"}\n{"id": 3, "x": "c"}\n')
    go()
    out = spark.read.schema("id long, x string").json(f"{tmp_path}/out").collect()
    assert sorted((r.id, r.x) for r in out) == [(1, "A"), (2, "B"), (3, "C")]


def test_torn_files_are_skipped_with_a_warning(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "torn.jsonl").write_text('{"a": 3}\n{"a": \n')
    (tmp_path / "note.txt").write_text("x")
    with pytest.warns(UserWarning) as seen:
        assert sorted(r.a for r in files.load_results(spark, f"{tmp_path}/*", "a int").collect()) == [1, 2]
    assert {str(w.message).split(": ")[-1] for w in seen if "is skipped" in str(w.message)} == {"it has a line that is no JSON", "its format is not supported"}


def test_statistics_in_a_footer(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"a": [1]})
    pq.write_table(table.replace_schema_metadata({"expansion_stats": '{"initial_commits": 5, "file_changes": 7}'}), tmp_path / "t.parquet")
    pq.write_table(table, tmp_path / "u.parquet")
    assert files.expansion_stats(spark, f"{tmp_path}/t.parquet").first() == (5, 1, 7, 1)
    assert files.expansion_stats(spark, f"{tmp_path}/u.parquet").first() == (1, 1, 1, 1) == files.expansion_stats(spark, f"{tmp_path}/none.parquet").first()


def test_records_by_commit(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "x"), ("c2", "y"), ("c1", None)], "commit_hash string, code string")
    files.save_by_commit(rows, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").glob("commit_hash=*")) == ["commit_hash=c1", "commit_hash=c2"]
    assert spark.read.json(f"{tmp_path}/out/commit_hash=c1").count() == 2
    kept = files.verify_groups(rows.where("code is not null"), 5)
    assert kept.rdd.getNumPartitions() == 5 and kept.count() == 2


def test_yaml():
    text = """
# settings
model: gpt  # the default
ratio: 0.8
"quoted: key": 'it''s # no comment'
steps:
  - name: one
    on: true
    list: [1, "two, three", {a: b}]
  - plain
  -
    - nested
empty:
same:
- a
- b: 1
path: http://x.example/#y
"""
    want = {"model": "gpt", "ratio": 0.8, "quoted: key": "it's # no comment", "steps": [{"name": "one", "on": True, "list": [1, "two, three", {"a": "b"}]}, "plain", ["nested"]], "empty": None, "same": ["a", {"b": 1}], "path": "http://x.example/#y"}
    assert files.read_yaml(text) == want and files.read_yaml("") is None
    for bad in ("a: |\n  x", "a: b\n   c: d", "just text\nmore", "a: 1\n--- \nb: 2"):
        with pytest.raises(ValueError):
            files.read_yaml(bad)
