import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import udfs as U
from tessella.operators import curation as C
from tessella.operators import metrics as M
from tessella.operators import mining as N
from tessella.operators import responses as R
from tessella.operators import runner as X
from tessella.operators import store as S


def change(spark, **values):
    names = [f.strip().split(" ")[0] for f in schemas.FILE_CHANGES.split(",")]
    base = dict.fromkeys(names) | {
        "message": "feat(A/B): x", "change_type": "modified", "file_path_after": "Mathlib/A.lean", "filtered_pure_changes": 5, "filtered_added_lines": 5, "filtered_absolute_added_lines": 5, "filtered_gold_diff": "+a\n+b",
    }
    return spark.createDataFrame([tuple((base | values)[n] for n in names)], schemas.FILE_CHANGES)


@pytest.mark.parametrize(
    "values, kept",
    [
        ({}, 1), ({"message": "feat: x"}, 0), ({"change_type": "deleted"}, 0), ({"file_path_after": "Mathlib.lean"}, 0), ({"file_path_after": "Test/A.lean"}, 0), ({"filtered_pure_changes": None}, 0),
        ({"filtered_pure_changes": 101}, 0), ({"filtered_pure_changes": 100}, 1), ({"filtered_absolute_added_lines": -4}, 0), ({"filtered_absolute_added_lines": -4, "filtered_added_lines": 6}, 1), ({"filtered_gold_diff": "+a\n+a\n+a"}, 0),
    ],
)
def test_curation(spark, values, kept):
    rows = change(spark, **values)
    assert C.curate(rows, C.stages()).count() == kept
    assert C.waterfall(rows, C.stages()).orderBy("stage").collect()[-1].after == kept


def test_waterfall_equals_step_by_step(spark):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("id") % 10))
    steps = [("a", F.col("x") > 2, ""), ("b", F.col("id") % 2 == 0, ""), ("c", F.col("x") < 8, "")]
    got = C.waterfall(df, steps, [("pairs", F.count(F.lit(1)), "")]).orderBy("stage").collect()
    left, want = df, []
    for _, keep, _ in steps:
        before = left.count()
        left = left.where(keep)
        want.append((before, left.count()))
    assert [(r.before, r.after) for r in got[1:]] == want and got[0].name == "pairs"


def test_single_parent_raises_on_merges(spark):
    rows = spark.createDataFrame([(["a"],), (["a", "b"],)], "parent_commit_hash array<string>")
    assert [r[0] for r in C.single_parent(rows, True).collect()] == ["a"]
    with pytest.raises(PySparkException):
        C.single_parent(rows).collect()


def test_reindex_and_medians(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id int, d int")
    assert sorted((r.d, r["index"]) for r in C.reindex(rows, "d", "id").collect()) == [(d, 100 - d) for d in range(101)]
    four = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    assert C.upper_median(four, F.col("v")).first().median == 3
    one = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [tuple(r) for r in C.histogram(one, F.col("v")).collect()] == [(1, 5.0, 5.0, 2)]
    assert sum(r.n for r in C.histogram(four, F.col("v"), 3).collect()) == 4


def test_token_limit_counts_null_as_empty(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, "a b c d")], "id int, t string")
    assert sorted((r.id, r.input_tokens) for r in C.token_limit(rows, "t", 3).collect()) == [(1, 2), (2, 0), (3, 2)]
    assert C.token_limit(rows, "t", 3, U.token_counter(lambda t: list(t))).count() == 3


RESPONSES = "h string, responses array<struct<code:string>>"


def test_merge_last_wins_and_keeps_nulls(spark):
    rows = spark.createDataFrame([("h1", [("x",), None, ("y",)]), ("h1", [("y",)]), ("h2", [("x",)]), (None, [("x",)]), ("h1", [])], RESPONSES)
    verdicts = spark.createDataFrame([("h1", "x", False, 1), ("h1", "x", True, 2)], "h string, code string, ok boolean, at int")
    out = R.merge_verdicts(rows, verdicts, ["h"], "code", "at", F.struct(F.col("ok").alias("complete")), F.struct(F.lit(False).alias("complete"))).collect()
    assert len(out) == 1 and [r and r.verification_result.complete for r in out[0].responses] == [True, None, False]


def test_votes(spark):
    rows = spark.createDataFrame([(1, v, i) for i, v in enumerate(["good", "poor", "poor", "good", "odd"])], "k int, v string, at int")
    out = R.vote(rows, ["k"], "v", "at").first()
    assert out.majority == "good" and out.counter == {"good": 2, "poor": 2, "odd": 1}
    assert R.worst(rows, ["k"], "v", ("unacceptable", "poor", "good")).first().worst == "poor"
    one = spark.createDataFrame([(["b", None, "a", "a", "b"],), ([],), (None,)], "v array<string>")
    assert [r.m for r in one.select(R.majority_of(F.col("v")).alias("m")).collect()] == ["b", None, None]
    assert one.select(R.worst_of(F.col("v"), ("a", "b")).alias("m")).first().m == "a"


def test_judgements(spark):
    ddl = "r array<struct<TaskEvaluations:map<string,string>>>"
    rows = [([({"1": "Good", "2": "poor"},), ({"1": "excellent"},)],), ([({"1": "good", "2": "poor"},)],), ([None, (None,), ({"1": "good"},)],), ([({"1": "acceptable"},)],)]
    out = spark.createDataFrame(rows, ddl).select(R.judged_well(F.col("r")).alias("k")).collect()
    assert [r.k for r in out] == [True, False, True, False]


def test_candidates_and_flatten(spark):
    ddl = "commit_hash string, file_path_after string, responses array<struct<best_gen_content:string>>"
    rows = spark.createDataFrame([("h", "A/B.lean", [("x",), ("x",), None, (None,), ("import A.B\n",)])], ddl)
    assert [tuple(r) for r in R.candidates(rows).collect()] == [("h", "x")]
    full = spark.createDataFrame([("T", [("t", "i"), ("u", "j")])], "f string, e array<struct<title:string,instruction:string>>")
    assert full.select(R.full_instruction(F.col("e")).alias("x")).first().x == "- Task 1: t\n\ni\n\n\n- Task 2: u\n\nj"
    assert full.select(R.full_instruction(F.col("e"), F.col("f")).alias("x")).first().x == "T"


def test_metrics_grid_and_padding(spark):
    rows = spark.createDataFrame([("m", 0.5, 2, "t1", True), ("m", 0.5, 2, "t1", False), ("m", 0.5, 2, "t2", False)], "model string, temperature double, n_responses int, t string, ok boolean")
    tasks = M.counts_by_task(rows, ["t"], F.col("ok"))
    found = M.pass_at_k(tasks, total=4, ratio=1.0)
    assert {(r.k, r.pass_at_k) for r in found.collect()} == {(1, 0.125), (2, 0.25)}
    grid = M.complete_grid(found, spark.createDataFrame([("q", 1.0, 2)], "model string, temperature double, n_responses int"), 1.0)
    assert {(r.model, r.k, r.pass_at_k) for r in grid.collect()} == {("m", 1, 0.125), ("m", 2, 0.25), ("q", 1, 0.0), ("q", 2, 0.0)}
    assert M.nested(found).first().metrics == {"0.5,2": {"pass@1_of_2": 0.125, "pass@2_of_2": 0.25}}
    assert "| m | 0.5 | 2 | 1 | 0.1250 |" in M.markdown(found) and "12.50%" in M.markdown(found, True)
    assert {r.model for r in M.labels_of(found, grid).collect()} == {"m", "q"}


def test_store(spark):
    files = spark.createDataFrame([("c1", "a", "regular", b"x"), ("c1", "b", "regular", b"x"), ("c2", "a", "symlink", b"yy")], "commit_id string, rel_path string, type string, content binary")
    fresh = S.absent(files, spark.createDataFrame([], "hash string"))
    assert fresh.count() == 2 and S.absent(files, fresh).count() == 0 and S.present(S.snapshot(files), fresh).count() == 3
    back = S.restore(S.snapshot(files), fresh).collect()
    assert {(r.commit_id, r.rel_path, bytes(r.content)) for r in back} == {("c1", "a", b"x"), ("c1", "b", b"x"), ("c2", "a", b"yy")}
    assert S.sizes(files).first().ratio == 4 / 3


def test_upsert_merges_extras(spark):
    old = spark.createDataFrame([("c", "pending", "1", {"a": "1", "b": "1"}), ("d", "ready", "1", None)], "commit_id string, status string, updated_at string, extras map<string,string>")
    new = spark.createDataFrame([("c", "ready", "2", {"b": "2"})], old.schema)
    out = {r.commit_id: r for r in S.upsert(old, new, ["commit_id"], "updated_at", "extras").collect()}
    assert out["c"].status == "ready" and out["c"].extras == {"a": "1", "b": "2"} and out["d"].extras == {}
    moves = {(r.status, r.allowed) for r in S.checked_moves(old, spark.createDataFrame([("c", "ready"), ("d", "collapsed"), ("e", "pending")], "commit_id string, status string")).collect()}
    assert moves == {("ready", False), ("collapsed", True), ("pending", True)}


def test_mining(spark):
    text = "\n\n".join(f"def a{i} := {i}" for i in range(6))
    diff = "@@ -0,0 +1,11 @@\n" + "\n".join("+" + l for l in text.split("\n"))
    names = "commit_hash author message date parent_commit_hash toolchain_content parent file_path_before file_path_after content_before content_after gold_diff copied".split()
    values = dict(commit_hash="c", parent_commit_hash=["p"], parent="p", file_path_after="A.lean", content_after=text, gold_diff=diff)
    raw = N.classified(spark.createDataFrame([tuple(values.get(n) for n in names)], schemas.RAW_CHANGE))
    out = N.file_changes(raw.drop("copied", "parent"), 4).collect()
    assert len(out) > 2 and out[-1].content_after == text and all(r.is_split_hunk and r.change_type == "created" for r in out)
    assert N.file_changes(raw.drop("copied", "parent"), 100).first().filtered_added_lines == 11


def test_one_evaluation_of_a_filtered_function(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string").withColumn("e", U.edit_runs(F.col("a"), F.col("b"))).where("e.total > 0").select("e.total", "e.blocks")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and df.count() == 1


def test_functions_in_sql(spark):
    U.register_all(spark)
    assert spark.sql("select strip_comments('a -- b') x").first().x == "a "


def test_resumable_runner(spark, tmp_path):
    rows = spark.createDataFrame([(i,) for i in range(6)], "id int")
    calls = tmp_path / "calls"
    calls.mkdir()

    def work(row):
        mark = calls / str(row["id"])
        mark.write_text(mark.read_text() + "x" if mark.exists() else "x")
        if row["id"] == 5 or (row["id"] == 3 and len(mark.read_text()) < 2):
            raise ValueError
        return {"id": row["id"], "y": row["id"] * 2}

    left = X.run_resumable(rows, work, "id int, y int", f"{tmp_path}/out", "id", 2)
    assert [r.id for r in left.collect()] == [5] and len((calls / "5").read_text()) == 3 and (calls / "1").read_text() == "x"
    again = X.run_resumable(rows.where("id < 5"), work, "id int, y int", f"{tmp_path}/out", "id", 2)
    assert again.isEmpty() and (calls / "1").read_text() == "x"


def test_pipeline_hooks():
    class Echo(X.Pipeline):
        def get_input(self, row):
            return row["q"]

        def call(self, prompt):
            return prompt.upper()

        def stop(self, responses):
            return len(responses) == 2

        def update(self, state, parsed):
            return {"n": state.get("n", 0) + 1}

    assert Echo(samples=5).row({"q": "a"}) == {"q": "a", "n": 2, "responses": [{"raw_response": "A"}] * 2}
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert X.with_retries(flaky, sleep=lambda s: None)() == "ok" and len(tries) == 3
    assert X.provider("big-model", [("big", "p")], "d") == "p" and "temperature" not in X.parameters("o-x", 0.5, 10, ("o-",))


def test_groups_and_progress(spark):
    rows = spark.createDataFrame([("c", i) for i in range(50)], "commit_hash string, i int")
    cut = X.sliced(rows, "commit_hash", 10, "i")
    out = X.by_group(cut, ["commit_hash", "slice"], lambda f: pd.DataFrame({"n": [len(f)]}), "n long").collect()
    assert sum(r.n for r in out) == 50 and len(out) == 5
    progress = spark.createDataFrame([("a", True, 1, ["f"]), ("b", False, 0, ["g"])], "model string, completed boolean, last_completed_config int, output_files array<string>")
    configs = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("c", 0)], "model string, position int")
    assert {tuple(r) for r in X.next_config(progress, configs).collect()} == {("b", 1), ("c", 0)} and [r.file for r in X.completed_files(progress).collect()] == ["f"]
