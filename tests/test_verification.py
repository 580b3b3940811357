import hashlib
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import mining as N
from tessella.operators import responses as R
from tessella.operators import runner as X
from tessella.operators import store as S
from tessella.operators import verification as V


def test_check_of_one_text(tmp_path):
    script = "import sys; t = open(sys.argv[1]).read(); print('x: Error: bad' if 'bad' in t else 'warning: w' if 'warn' in t else 'fine'); sys.exit(2 if 'exit' in t else 0)"
    command = [sys.executable, "-c", script]
    seen = {t: (r["pass"], r["complete"], r["returncode"]) for t in ("ok", "bad", "warn", "exit") for r in [V.check(t, str(tmp_path), command)]}
    assert seen == {"ok": (True, True, 0), "bad": (False, False, 0), "warn": (True, False, 0), "exit": (False, False, 2)}
    none = V.check("x", str(tmp_path), ["no-such-program"])
    assert not none["pass"] and none["returncode"] is None and "FileNotFoundError" in none["system_error"]


def test_timeout_ends_children_too(tmp_path):
    (tmp_path / "late.py").write_text(f"import time; time.sleep(3); open({str(tmp_path / 'late')!r}, 'w')")
    child = f"import subprocess, sys, time; subprocess.Popen([sys.executable, {str(tmp_path / 'late.py')!r}]); time.sleep(60)"
    start = time.time()
    with pytest.raises(subprocess.TimeoutExpired):
        V.run([sys.executable, "-c", child], str(tmp_path), 1.5)
    assert time.time() - start < 10
    time.sleep(3)
    assert not (tmp_path / "late").exists()


def test_restore_keeps_inside_the_worktree(tmp_path):
    entries = [("a/b", "h1", "regular"), ("link", "h2", "symlink"), ("../out", "h3", "regular"), ("c", "none", "regular")]
    blobs = {"h1": b"one", "h2": b"a/b", "h3": b"x"}
    assert V.restore(entries, blobs.__getitem__, str(tmp_path / "w")) == 2 if (tmp_path / "w").mkdir() is None else None
    assert (tmp_path / "w/link").read_bytes() == b"one" and not (tmp_path / "out").exists()


def test_build_hash_store_and_verify(spark, tmp_path):
    """Worktrees built with a cache that fails twice, kept once each in the store, restored, and their records checked."""
    tries = tmp_path / "tries"
    tries.mkdir()

    def checkout(commit, folder):
        if commit == "c9":
            raise OSError("no such commit")
        with open(f"{folder}/name", "w") as f:
            f.write("shared" if commit < "c2" else commit)
        os.makedirs(f"{folder}/d")
        os.symlink("../name", f"{folder}/d/l")

    def cache(folder):
        mark = tries / hashlib.sha256(folder.encode()).hexdigest()
        with open(mark, "a") as f:
            f.write("x")
        if len(mark.read_text()) < 3:
            raise OSError("busy")

    commits = spark.createDataFrame([("c0",), ("c1",), ("c2",), ("c3",), ("c9",)], "commit_id string")
    built = V.build(commits, checkout, cache, lambda folder: "does not compile" if open(f"{folder}/name").read() == "c3" else None, 3, 0.0)
    rows = built.collect()
    assert {r.commit_id: r.status for r in rows} == {"c0": "collapsed", "c1": "collapsed", "c2": "collapsed", "c3": "failed", "c9": "failed"}
    assert sorted((r.commit_id, r.rel_path, r.type, bytes(r.content)) for r in rows if r.rel_path) == sorted(x for c, n in (("c0", b"shared"), ("c1", b"shared"), ("c2", b"c2")) for x in ((c, "name", "regular", n), (c, "d/l", "symlink", b"../name")))
    files = spark.createDataFrame(rows, V.BUILT).where("rel_path is not null").select("commit_id", "rel_path", "type", "content")
    S.put(files, f"{tmp_path}/store")
    S.put(files, f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 3
    contents = S.absent(files, spark.createDataFrame([], "hash string"))
    once, again = (S.put_files(contents, f"file://{tmp_path}/blobs").where("written").count() for _ in range(2))
    assert (once, again) == (3, 0)
    place = str(tmp_path / "blobs")

    def blob(digest):
        with open(f"{place}/{digest[:2]}/{digest[2:4]}/{digest}", "rb") as f:
            return f.read()

    records = spark.createDataFrame([("c0", f"code {i}") for i in range(30)] + [("c2", "x"), ("c2", None), ("c7", "y")], "commit_hash string, code string")
    hooks = V.Hooks(blob, lambda folder: None if os.path.exists(f"{folder}/d/l") else "no link", lambda code, folder: {"pass": True, "complete": open(f"{folder}/d/l").read() == "shared"})
    out = V.verify(records, S.snapshot(files), hooks, per_slice=7).collect()
    assert len(out) == 32 and {(r.commit_hash, r.status) for r in out} == {("c0", "ready"), ("c2", "ready"), ("c7", "failed_verify")}
    assert all(r.verification_result.complete == (r.commit_hash == "c0") for r in out if r.status == "ready")


def test_toolchains_are_installed_once(spark, tmp_path):
    def hook(name):
        if name == "bad":
            raise ValueError("unknown")
        os.makedirs(tmp_path / name)

    out = V.install(spark.createDataFrame([("v1",), ("v1",), ("v2",), ("bad",)], "toolchain string"), hook, 2).collect()
    assert {(r.toolchain, r.installed, r.message) for r in out} == {("v1", True, None), ("v2", True, None), ("bad", False, "unknown")}


def test_row_map_counts_errors_and_keeps_order_of_samples(spark):
    def work(row):
        if row["i"] % 3 == 0:
            raise ValueError("three")
        return {**row, "v": row["i"] * 2}

    rows = spark.range(10).selectExpr("cast(id as int) i")
    done = X.apply_rows(rows, work, "i int, v int, error string", threads=3, error="error")
    assert X.outcomes(done).first() == (6, 4, 0.6) and {r.error for r in done.collect()} == {None, "ValueError: three"}
    assert X.apply_rows(rows, work, "i int, v int").count() == 6


def test_patch_pipeline_and_submission():
    class Stub(X.Submission):
        calls = 0

        def call(self, prompt):
            assert prompt == "a\nb\n\ndo it"
            self.calls += 1
            return "no patch" if self.calls == 1 else "```diff\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n```"

    out = Stub(samples=5, model="m").row({"content_before": "a\nb", "full_instruction": "do it"})
    assert out["model_name"] == "m" and out["responses"][0] is None and out["responses"][1]["best_gen_content"] == "a\nc" and len(out["responses"]) == 2


def test_progress_ledger(spark, tmp_path):
    old = spark.createDataFrame([("models", "a", "1"), ("verification", "v", "1")], "key string, value string, updated_at string")
    new = spark.createDataFrame([("models", "b", "2"), ("verification", "w", "2"), ("last_updated", "2", "2")], "key string, value string, updated_at string")
    assert {(r.key, r.value) for r in X.upsert_progress(old, new, ["models"]).collect()} == {("models", "b"), ("verification", "v"), ("last_updated", "2")}
    assert {r.value for r in X.upsert_progress(old, new).collect()} == {"b", "w", "2"}
    configs = spark.createDataFrame([("m", 0, "f0"), ("m", 1, "f1"), ("n", 0, "g0")], "model string, position int, path string")
    none = spark.createDataFrame([], "model string, completed boolean, last_completed_config int, output_files array<string>")
    named = X.register_outputs(none, configs)
    assert {(r.model, tuple(r.output_files)) for r in named.collect()} == {("m", ("f0", "f1")), ("n", ("g0",))} and X.next_config(named, configs).count() == 3
    ran = X.record_config(named, "m", 0, configs)
    assert {(r.model, r.position) for r in X.next_config(ran, configs).collect()} == {("m", 1), ("n", 0)}
    ended = X.record_config(ran, "m", 1, configs)
    assert {r.model for r in X.next_config(ended, configs).collect()} == {"n"} and X.completed_files(ended).count() == 2
    assert X.save_missing(spark.range(3), f"{tmp_path}/missing", "id") == 3
    made = []
    for _ in range(2):
        X.cached(spark, f"{tmp_path}/cache", lambda: made.append(1) or spark.range(4)).count()
    assert made == [1] and X.dealt(spark.range(9), 3).rdd.getNumPartitions() == 3
    name = spark.range(1).select(X.run_name(F.lit("in"), F.lit("m"))).first()[0]
    assert name.split("__")[1:3] == ["in", "m"] and len(name.split("__")) == 4


def test_repair_with_errors_and_time(spark):
    rows = spark.createDataFrame([("m", "a\nb", "@@ -1 +1 @@\n a\n-b\n+c"), ("m", "a\nb", "@@ -1 +1 @@\n-nothing like it\n+c"), ("n", "a", None)], "model string, content_before string, gen_patch string")
    done = R.repaired(rows)
    stats = {r.model: r for r in R.repair_stats(done).collect()}
    assert (stats["m"].total, stats["m"].success, stats["m"].failure, stats["n"].success) == (2, 1, 1, 0) and stats["m"].time_taken > 0
    good, bad = R.split_repaired(done)
    assert good.first().content_after_gen_diff == "a\nc" and {r.error for r in bad.collect()} == {"no hunk finds its place", "no diff"}


def test_statistics_survive_odd_rows(spark):
    rows = spark.createDataFrame([(1, "def a := 1", "def a := 2", 7.0), (2, None, None, 7.0)], "id int, content_before string, content_after string, changed_def_count double")
    out = {r.id: r for r in N.with_statistics(rows, "id").collect()}
    assert out[1].changed_def_count == 1 and out[2].input_tokens == 0 and out[1].module == "other"
    assert N.expansion_totals(spark.createDataFrame([(1, 2, 3, 4), (1, 1, 1, 1)], "initial_commits long, commit_parent_pairs long, file_changes long, final_file_changes long")).first() == (2, 3, 4, 5)


def test_small_functions(spark):
    row = spark.range(1).select(T.greyed(F.lit("#ff0000"), 1.0).alias("g"), T.greyed(F.lit("#1A2b3c"), 0.0).alias("s"), T.json_text(F.lit(None).cast("string").alias("a"), F.array(F.lit(1)).alias("b"), F.lit("2024-01-02").cast("date").alias("d")).alias("j")).first()
    assert row.g == "#4c4c4c" and row.s == "#1a2b3c" and row.j == '{"a":null,"b":[1],"d":"2024-01-02"}'
