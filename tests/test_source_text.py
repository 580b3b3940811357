import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import repair as R
from tessella.functions import source_text as S


def comments_by_hand(t):
    out, i, n = [], 0, len(t)
    while i < n:
        if t.startswith("--", i):
            j = t.find("\n", i)
            if j < 0:
                break
            i = j
        elif t.startswith("/-", i):
            depth, i = 1, i + 2
            while i < n and depth:
                if t.startswith("/-", i):
                    depth, i = depth + 1, i + 2
                elif t.startswith("-/", i):
                    depth, i = depth - 1, i + 2
                else:
                    i += 1
        else:
            out.append(t[i])
            i += 1
    return "".join(out)


@pytest.mark.parametrize("text, want", [("a -- c\nb", "a \nb"), ("a -- c", "a "), ("a /- x /- y -/ z -/ b", "a  b"), ("a /- open", "a "), ("a -/ b", "a -/ b")])
def test_strip_comments(text, want):
    assert S.strip_comments(text) == want


@settings(max_examples=500, deadline=None)
@given(st.text("-/a\n", max_size=14))
def test_strip_comments_like_a_plain_loop(text):
    assert S.strip_comments(text) == comments_by_hand(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_diff_then_apply(a, b):
    before, after = "\n".join(["head", *a, "tail"]), "\n".join(["head", *b, "tail"])
    diff = S.unified_diff(before, after)
    assert (S.apply_diff(before, diff) if diff else before) == after
    assert not diff or S.diff_counts(diff)[3] == len(b) - len(a)


def test_apply_to_nothing_and_failure():
    assert S.apply_diff("", "@@ -0,0 +1,2 @@\n+a\n+b") == "a\nb"
    assert S.apply_diff("x\ny", "@@ -1,1 +1,1 @@\n-q\n+r") is None


def test_chunks():
    blocks = ["\n".join(f"{k}{i}" for i in range(n)) for k, n in zip("abc", (4, 4, 5))]
    text = "\n\n".join(blocks)
    steps = S.chunk_new_file(text, 10)
    assert len(steps) == 2 and steps[-1][1] == text and steps[0][0] == "" and all(a[1] == b[0] for a, b in zip(steps, steps[1:]))
    assert len(S.chunk_new_file("a\n\n/- x\n\ny -/\n\nb", 1)) == 3
    assert S.chunk_new_file("", 3) == []


def test_hunks_in_sequence():
    before = "\n".join(map(str, range(40)))
    after = before.replace("5\n6", "5\nnew\n6", 1).replace("\n30\n", "\n")
    diff = S.unified_diff(before, after, headers=False)
    steps = S.split_hunks(before, diff)
    assert len(steps) == 2 and steps[0][0] == before and steps[-1][1] == after
    overlap = "@@ -1,5 +1,5 @@\n 0\n-1\n+x\n 2\n 3\n 4\n@@ -5,2 +5,2 @@\n-4\n+y\n 5"
    assert S.split_hunks(before, overlap) is None
    assert S.split_change(before, after, overlap, "modified", 1) == [(before, after, overlap, False)]
    assert [h["count"] for h in S.parse_hunks("@@ -3 +4 @@\n-a\n+b\n@@ -1,0 +2,2 @@\n+x\n+y")] == [0, 1]


def test_filtered_diff_of_comment_edit():
    assert S.filtered_diff("def a := 1 -- x", "def a := 1 -- y") == ("", None, None, None, None)
    assert S.filtered_diff(None, "def a := 1\n")[1:] == (1, 1, 1, 1)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_edit_runs_total(a, b):
    few, blocks, total = S.edit_runs(a, b)
    assert total == levenshtein(a, b) and few + 2 * blocks <= total


def test_edit_runs_kinds():
    assert S.edit_runs("abcdef", "abXdef") == (1, 0, 1) and S.edit_runs("abc", "abcxyz") == (0, 1, 3)
    assert S.good_edit("", "x") and not S.good_edit("a b -- c", "a  b") and S.good_edit("theorem a", "theorem a" + "new text here") and not S.good_edit("abcdef", "abXdef")


def test_definitions_and_pairs():
    text = "namespace X\ntheorem foo.bar (x : Nat) : x = x := by\n  rfl\n\ndef baz := (1 : Nat)\nend X\nexample : True := trivial\n"
    found = S.definitions(text)
    assert [(d["kind"], d["name"], d["start"]) for d in found] == [("theorem", "foo", 2), ("def", "baz", 5), ("theorem", "True", 7)]
    assert found[1]["content"] == "def baz := (1 : Nat)"
    stats = S.pair_stats(text, text.replace("rfl", "simp") + "lemma new : 1 = 1 := rfl\n")
    assert len(stats) == 24 and stats["changed_theorem_count"] == 1 and stats["added_theorem_count"] == 1 and stats["affected_theorem_count"] == 2
    assert stats["avg_deleted_def_line_count"] == 0 and stats["changed_theorem_line_count"] == 1
    kinds = [t[0] for t in S.tokens('def "s" -- c\n1')]
    assert kinds == ["definition", "string", "comment", "unknown", "eof"]


def test_exercises():
    answer = "x Exercises in Lean\n### Exercise 1: **T one**\n- **Diff Hunk Span:** @@ -1 +1 @@\n- **Task Category:** Feature\n- **Focus:** F\n- **Difficulty:** Easy\n- **Task Nature:** Substantial\n- **Problem Statement:** Do it.\n"
    got = S.exercises(answer + answer[20:].replace("Exercise 1", "Exercise 2"))
    assert [g["num"] for g in got] == [1, 2] and got[0]["difficulty"] == "Easy" and got[0]["instruction"] == "Do it."
    assert S.exercises("nothing") is None and S.exercises(answer + "(Continue similarly") is None and S.exercises(None) is None


ORIGINAL = "\n".join(f"line {i} of the text" for i in range(40))


def repaired(diff):
    patch, content = R.repair(ORIGINAL, diff)
    return content if patch is None else S.apply_diff(ORIGINAL, patch)


def test_repair_wrong_numbers_and_no_header():
    want = ORIGINAL.replace("line 6 of the text", "six")
    body = " line 5 of the text\n-line 6 of the text\n+six\n line 7 of the text"
    assert repaired("@@ -99,3 +1,7 @@\n" + body) == want == repaired(body)


def test_repair_altered_context():
    want = ORIGINAL.replace("line 21", "new\nline 21")
    assert repaired("@@ x @@\n   LINE 20 of the TEXT\n+new\n line 21 of the text") == want
    missing = "@@ @@\n line 10 of the text\n-line 12 of the text\n+twelve\n line 13 of the text"
    assert "twelve" in repaired(missing) and "line 11 of the text" in repaired(missing)


def test_repair_overlap_whole_file_and_failure():
    a = "@@ @@\n line 5 of the text\n-line 6 of the text\n+six\n"
    b = "@@ @@\n line 5 of the text\n-line 6 of the text\n-line 7 of the text\n+both\n"
    assert repaired(a + b) == ORIGINAL.replace("line 6 of the text\nline 7 of the text", "both")
    assert R.repair(ORIGINAL, "+all\n+new") == (None, "all\nnew")
    assert R.repair(ORIGINAL, "@@ @@\n-entirely different words\n+x") == (None, None)
    partly = "@@ @@\n-entirely different words\n+x\n" + a
    assert repaired(partly) == ORIGINAL.replace("line 6 of the text", "six")


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_repair_of_synthetic_diffs(seed):
    rng = random.Random(seed)
    lines = [f"{i} {rng.random()} w{rng.randrange(9)}" for i in range(30)]
    new = list(lines)
    for _ in range(rng.randrange(1, 4)):
        at = rng.randrange(len(new))
        if rng.random() < 0.5:
            new[at] = f"changed {rng.random()}"
        else:
            new.insert(at, f"added {rng.random()}")
    diff = S.unified_diff("\n".join(lines), "\n".join(new))
    broken = "\n".join("@@ -1,1 +7,7 @@" if l.startswith("@@") else l for l in diff.split("\n"))
    patch, _ = R.repair("\n".join(lines), broken)
    assert S.apply_diff("\n".join(lines), patch) == "\n".join(new)


def test_response():
    answer = "ok\n```diff\n@@ -9 +9 @@\n line 5 of the text\n+added\n```"
    got = R.response(ORIGINAL, answer)
    assert got["best_gen_content"] == ORIGINAL.replace("line 6", "added\nline 6", 1) and got["best_gen_patch"].startswith("--- a/file")
    assert R.response("", "```diff\n+a\n+b\n```")["best_gen_content"] == "a\nb" and R.response(ORIGINAL, "no") is None


@pytest.mark.parametrize("moved", [-700, -200, -199, 0, 199, 200, 700])
def test_hunks_apply_however_far_lines_have_moved(moved):
    lines = [f"line {i}" for i in range(2000)]
    new = lines[:1000] + ["added"] + lines[1001:1005] + lines[1006:]
    diff = S.unified_diff("\n".join(lines), "\n".join(new))
    before = [f"top {i}" for i in range(moved)] + lines[max(0, -moved) :]
    after = [f"top {i}" for i in range(moved)] + new[max(0, -moved) :]
    assert S.apply_diff("\n".join(before), diff) == "\n".join(after)
    assert S.apply_diff("\n".join(before), diff.replace("line 999", "no line")) is None
    assert S.apply_diff("a\nb\nc", "@@ -9000000,1 +9000000,1 @@\n-b\n+d") == "a\nd\nc"


def test_apply_ignores_blanks_and_leaves_out_context_at_the_ends():
    text = "one\ntwo  words\tapart\nthree\nfour\nfive"
    diff = "@@ -1,5 +1,5 @@\n one\n two words apart  \n-three\n+3\n four\n five"
    assert S.apply_diff(text, diff) == "one\ntwo  words\tapart\n3\nfour\nfive"
    for first in ("ONE", "one"):
        fuzzy = f"@@ -1,5 +1,5 @@\n {first}\n two words apart\n-three\n+3\n four\n FIVE"
        assert S.apply_diff(text, fuzzy) == "one\ntwo  words\tapart\n3\nfour\nfive" and S.apply_diff(text, fuzzy, 0) is None
    assert S.apply_diff(text, "@@ -1,5 +1,5 @@\n a\n b\n-three\n+3\n c\n d") == "one\ntwo  words\tapart\n3\nfour\nfive"
    assert S.apply_diff(text, "@@ -1,7 +1,7 @@\n z\n a\n b\n-three\n+3\n c\n d\n e") is None


def test_insertion_after_a_lost_blank_line_gets_one():
    from tessella.functions import repair as R

    hunk = R.Hunk([(" ", "alpha beta"), (" ", ""), ("+", "new"), (" ", "gamma")])
    assert R.rebuild(hunk, ["alpha beta", "gamma"]) == [(" ", "alpha beta"), ("+", ""), ("+", "new"), (" ", "gamma")]


def whole_table(x, y):
    """The traced script from a table that is kept whole."""
    rows = [list(range(len(y) + 1))]
    for i, c in enumerate(x, 1):
        row = [i]
        for j, d in enumerate(y, 1):
            row.append(min(rows[-1][j - 1] + (c != d), rows[-1][j] + 1, row[-1] + 1))
        rows.append(row)
    out, i, j = [], len(x), len(y)
    while i or j:
        if i and j and x[i - 1] == y[j - 1] and rows[i][j] == rows[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and j and rows[i][j] == rows[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(("r", i, j))
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            out.append(("d", i, j))
        else:
            j -= 1
            out.append(("i", i, j))
    return out[::-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abé😀", max_size=40), st.text("abé😀", max_size=40))
def test_scripts_are_those_of_the_whole_table(x, y):
    assert S._script(x, y) == whole_table(x, y)


def test_long_texts_have_shortest_scripts():
    import random

    rng = random.Random(1)
    a = "".join(rng.choice("abcdef") for _ in range(5000))
    b = "".join(c if rng.random() > 0.01 else rng.choice(["", "x", c + "y"]) for c in a)
    few, blocks, total = S.edit_runs(a, b)
    assert 0 < total < 100 and few + blocks <= total
    c = "z" + b[1:2500] + b[2510:] + "q"
    assert S.edit_runs(b, c)[2] <= 12 + 2


def filed(n, word="ab"):
    """The file of lean_files of n lines, before and after its edit, and what the edit's figures are."""
    import duckdb

    from tessella.plans.lean_files import FILES

    con = duckdb.connect()
    con.sql(f"CREATE TABLE documents AS SELECT 1 AS doc_id, array_to_string(list_transform(range({n}), lambda i: '{word}'), chr(10)) AS text")
    before, after, replaced, removed, last = con.sql(f"WITH {FILES} SELECT before, after, replaced, removed, last::INT FROM files JOIN edits USING (doc_id)").fetchall()[0]
    return before, after, (replaced + 1, 2 * replaced + removed + 1, replaced + removed + 1 - last, 1 - removed)


@pytest.mark.parametrize("n", [199, 208, 228, 248])
def test_filtered_diff_matches_frequent_lines(n):
    """From 200 lines on, a blank line after the last replaced line is no change."""
    before, after, counts = filed(n)
    assert S.filtered_diff(before, after)[1:] == counts


def test_diff_of_frequent_lines_only():
    old, new = "a\n\n" * 300, "b\n\n" * 300
    diff = S.unified_diff(old, new)
    assert S.diff_counts(diff)[:2] == (300, 600) and S.apply_diff(old, diff) == new


def test_repair_among_lines_that_are_alike():
    """Long lines that differ by their numbers only: a hunk with altered context goes where its lines are the same."""
    before, after, _ = filed(60, " ".join("abcdefghijklmnop"))
    broken = re.sub(r"(?m)^ theorem", " THEOREM", re.sub(r"@@ -\d+,\d+ \+\d+,\d+ @@", "@@ -1,1 +1,1 @@", S.unified_diff(before, after)))
    patch, _ = R.repair(before, broken)
    assert re.sub("\n+", "\n", S.apply_diff(before, patch)) == re.sub("\n+", "\n", after)


def test_patch_response_among_lines_that_are_alike():
    before, after, _ = filed(60, " ".join("abcdefghijklmnop"))
    broken = re.sub(r"(?m)^ theorem", " THEOREM", re.sub(r"@@ -\d+,\d+ \+\d+,\d+ @@", "@@ -1,1 +1,1 @@", S.unified_diff(before, after)))
    done = R.response(before, f"Here:\n```diff\n{broken}\n```\nThat is all.")
    for name in ("best_gen_content", "gen_content_after_exact_repair"):
        assert re.sub("\n+", "\n", done[name]) == re.sub("\n+", "\n", after)


def test_split_change_counts_frequent_lines():
    """The parts of a change of 248 lines whose last one is blank add up to its edit."""
    before, after, counts = filed(248)
    diff = S.unified_diff(before, after, headers=False)
    parts = S.split_change(before, after, diff, "modified", 5)
    assert len(parts) > 5 and parts[-1][1] == after
    assert tuple(map(sum, zip(*(S.diff_counts(d)[:2] for _, _, d, _ in parts), strict=True))) == counts[:2]


def test_arrow_functions_hold_slices_of_a_batch(spark):
    """A worker turns rows into Python values slice by slice, and every row comes back once, in order."""
    import pyarrow as pa

    from tessella.functions import udfs as U

    texts = [None if i % 7 == 0 else f"a{i} -- b" for i in range(2 * U.SLICE + 50)]
    out = list(U.strip_comments.build().func(iter([pa.array(texts[:1]), pa.array(texts[1:])])))
    assert max(map(len, out)) == U.SLICE
    want = [t and t[:-4] for t in texts]
    assert [v for a in out for v in a.to_pylist()] == want
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    assert [r.v for r in rows.select("i", U.strip_comments(rows.t).alias("v")).orderBy("i").collect()] == want


def test_patch_responses_of_every_length():
    """Answers over lines that are alike, at every place that the last edit and the last kinds of line have to one another."""
    for n in range(1, 121):
        before, after, _ = filed(n, " ".join("abcdefghijklmnop"))
        broken = re.sub(r"(?m)^ theorem", " THEOREM", re.sub(r"@@ -\d+,\d+ \+\d+,\d+ @@", "@@ -1,1 +1,1 @@", S.unified_diff(before, after)))
        done = R.response(before, f"Here:\n```diff\n{broken}\n```\nThat is all.")
        assert re.sub("\n+", "\n", done["best_gen_content"]) == re.sub("\n+", "\n", after), n


def test_split_changes_of_every_length():
    """From 200 lines on, where blank lines are frequent, the parts of changed and of new files add up to the edit and end in the whole file."""
    for n in range(200, 320):
        before, after, counts = filed(n)
        size = len(after.splitlines())
        for old, kind, want in ((before, "modified", counts[:2]), ("", "created", (size, size))):
            parts = S.split_change(old, after, S.unified_diff(old, after, headers=False), kind, 5)
            assert len(parts) > 5 and parts[-1][1] == after, (n, kind)
            assert tuple(map(sum, zip(*(S.diff_counts(d)[:2] for _, _, d, _ in parts), strict=True))) == want, (n, kind)
