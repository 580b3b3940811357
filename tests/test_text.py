import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T


def column(spark, rows, ddl, expression):
    return [r.x for r in spark.createDataFrame(rows, ddl).select(expression.alias("x")).collect()]


@pytest.mark.parametrize(
    "message, want",
    [("feat(Algebra/Group): add", "feat"), ("feat: add foo", None), ("feat\n", "feat"), ("chore.", "chore"), ("fix(Foo): x", None), ("faet(A/B): q", "feat"), ("Refactor (x/y): z", "refactor"), ("docs(A/B): q", None), ("", None), (None, None)],
)
def test_commit_type(spark, message, want):
    assert column(spark, [(message,)], "m string", T.commit_type(F.col("m"))) == [want]


@pytest.mark.parametrize("n, c, k, want", [(20, 0, 16, 0.0), (20, 3, 16, 0.9964912280701754), (20, 1, 1, 0.05), (20, 5, 1, 0.25), (0, 0, 1, 0.0), (4, 4, 3, 1.0)])
def test_pass_at_k(spark, n, c, k, want):
    got = column(spark, [(n, c, k)], "n int, c int, k int", T.pass_at_k(F.col("n"), F.col("c"), F.col("k")))[0]
    assert math.isclose(got, want, abs_tol=1e-12)


def test_pass_at_k_is_the_binomial_rule(spark):
    rows = [(n, c, k) for n in range(1, 9) for c in range(n + 1) for k in range(1, n + 1)]
    got = spark.createDataFrame(rows, "n int, c int, k int").select("n", "c", "k", T.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("x")).collect()
    assert all(math.isclose(r.x, 1 - math.comb(r.n - r.c, r.k) / math.comb(r.n, r.k), abs_tol=1e-9) for r in got)


@pytest.mark.parametrize(
    "lines, want", [(["-a", "+b"], (1, 2, 1, 0)), (["-a", "-b", "+c", "+d"], (2, 4, 3, 0)), (["+a", "-b"], (1, 2, 2, 0)), (["--- old comment", "+x"], (1, 1, 1, 1)), (["+++ x", "-y"], (0, 1, 1, -1)), ([], (0, 0, 0, 0))]
)
def test_diff_stats(spark, lines, want):
    assert tuple(column(spark, [("\n".join(lines),)], "d string", T.diff_stats(F.col("d")))[0]) == want


def test_strip_noncode_also_inside_words(spark):
    rows = [("import A\nx reopen y\nz\n#align a b\nset_option q",), ("\n \n",), ("a -- keep",)]
    assert column(spark, rows, "t string", T.strip_noncode(F.col("t"))) == ["x rez\n", "", "a -- keep"]


def test_repeat_ratios(spark):
    assert tuple(column(spark, [("+a\n+a\n+b\n-c\n+ \n x",)], "d string", T.repeat_ratios(F.col("d")))[0]) == (2 / 3, 1.0)


def test_anchor_match(spark):
    rows = [("abc", "abc"), ("abcd", "abcdef"), ("ab", "abcdef"), ("a b", "a c"), (" ".join("abcdefghijk"), " ".join("abcdefghijx")), ("", "")]
    assert column(spark, rows, "a string, b string", T.anchor_match(F.col("a"), F.col("b"))) == [True, True, False, False, True, True]


def test_compiler_output(spark):
    rows = [("fine\n\n  A warning \nERROR warning", 0), ("", 0), (None, None), ("ok", 1), ("Warning", 0)]
    lines = T.compiler_lines(F.col("o"))
    out = spark.createDataFrame(rows, "o string, rc int").select(lines.alias("l"), T.verdict(lines, F.col("rc")).alias("v")).collect()
    assert [x.type for x in out[0].l] == ["info", "warning", "error"] and out[0].l[1].message == "A warning"
    assert [tuple(r.v) for r in out] == [(False, False), (True, True), (False, False), (False, False), (True, False)]


def test_judgement_json(spark):
    rows = [('```json {"TaskEvaluations": {"1": "poor"}} ``` ```json {"TaskEvaluations": {"1": "good"}, "FinalOverallGrade": "good"} ```',), ('so {"a": 1, "TaskEvaluations": {"1": "poor"}} end',), ("none",), ("```json broken ```",)]
    out = column(spark, rows, "a string", T.parse_judgement(F.col("a")))
    assert out[0].TaskEvaluations == {"1": "good"} and out[1].TaskEvaluations == {"1": "poor"} and out[2] is None and out[3] is None


def test_fences(spark):
    rows = [("x ```diff\n-a\n+b\n``` y ```diff q```",), ("no",)]
    assert column(spark, rows, "a string", T.fenced_diff(F.col("a"))) == ["-a\n+b", None]
    rows = [("t ```lean\nline 3 a\nb\n```",), ("t ```lean\na\nb",), ("a\nb\nc",)]
    assert column(spark, rows, "a string", T.fenced_code(F.col("a"))) == ["a\nb", "a", "b"]


def test_paths_and_names(spark):
    rows = [("A/B.lean", "import A.B"), ("A/B.lean", "import  AxB\n"), ("A/B.lean", "import A.BC")]
    assert column(spark, rows, "p string, c string", T.imports_itself(F.col("p"), F.col("c"))) == [True, True, False]
    assert column(spark, [("A/B/c",), ("x",)], "p string", T.module_of(F.col("p"))) == ["B", "other"]
    assert column(spark, [("m",), ("q",)], "m string", T.series_label(F.col("m"), F.lit(0.5), {"m": "Model M"}, ("q",))) == ["Model M (T=0.5)", "q"]
    rows = [(None, None), (None, "a"), ("a", None), ("a", "b"), ("a", "a")]
    assert column(spark, rows, "a string, b string", T.change_type(F.col("a"), F.col("b"))) == ["unknown", "created", "deleted", "renamed", "modified"]


def test_tokens_of_a_public_vocabulary(spark):
    import os

    import pytest

    from tessella.functions import udfs as U
    from tessella.operators import curation as C

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    encode = U.RankEncoder(path)
    texts = ["hello world", "", None, "été 日本 x1y2", "a " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.n for r in C.with_tokens(rows, "t", U.token_counter(encode), "n").collect()}
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)} and got[0] == 2
