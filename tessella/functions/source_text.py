"""Sequential text algorithms over proof-library sources: comments, diffs, chunks, lexer, definitions, edit runs.

Plain Python without Spark; ``udfs`` wraps them as Arrow functions.
"""

from __future__ import annotations

import difflib
import math
import re
from itertools import pairwise

import numpy as np

_OUTSIDE, _INSIDE = re.compile("--|/-"), re.compile("/-|-/")
_COMMANDS = re.compile(r"#align.*?(?:\n|$)|set_option.*?(?:\n|$)|import.*?(?:\n|$)|open.*?(?:\n|$)|\A\s*\Z", re.S)


def strip_comments(text: str) -> str:
    """text without line comments (their line break stays) and nested block comments; an unclosed block runs to the end."""
    out, at, depth = [], 0, 0
    while m := (_INSIDE if depth else _OUTSIDE).search(text, at):
        if depth:
            depth += 1 if m[0] == "/-" else -1
            at = m.end()
            continue
        out.append(text[at : m.start()])
        if m[0] == "/-":
            depth, at = 1, m.end()
        else:
            at = text.find("\n", m.end())
            if at < 0:
                return "".join(out)
    return "".join(out) if depth else "".join(out) + text[at:]


def code_only(text: str) -> str:
    return strip_comments(_COMMANDS.sub("", text))


def _shared(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    names = {l: chr(k) for k, l in enumerate(set(a) & set(b), 2)}
    if not names:
        return []
    ops = _script("".join(names.get(l, "\0") for l in a), "".join(names.get(l, "\1") for l in b), 2)
    gone, new = {i for t, i, _ in ops if t != "i"}, {j for t, _, j in ops if t != "d"}
    return list(zip((i for i in range(len(a)) if i not in gone), (j for j in range(len(b)) if j not in new), strict=True))


class _Lines(difflib.SequenceMatcher):
    """Blocks of equal lines; where the base class leaves frequent lines of 200 or more out, they are matched in the gaps."""

    def get_matching_blocks(self):
        found = super().get_matching_blocks()
        if not self.bpopular:
            return found
        out, i, j = [difflib.Match(0, 0, 0)], 0, 0
        for m in found:
            for x, y, n in [*((i + x, j + y, 1) for x, y in _shared(self.a[i : m.a], self.b[j : m.b])), m]:
                if n and (x, y) == (out[-1].a + out[-1].size, out[-1].b + out[-1].size):
                    out[-1] = out[-1]._replace(size=out[-1].size + n)
                else:
                    out.append(difflib.Match(x, y, n))
            i, j = m.a + m.size, m.b + m.size
        self.matching_blocks = out[not out[0].size :]
        return self.matching_blocks


def _span(start: int, stop: int) -> str:
    n = stop - start
    return f"{start + 1}" if n == 1 else f"{start + (n > 0)},{n}"


def unified_diff(before: str, after: str, context: int = 3, headers: bool = True) -> str:
    """Unified diff with fixed file names; empty for equal texts."""
    a, b = before.splitlines(), after.splitlines()
    lines = ["--- a/file", "+++ b/file"] if headers else []
    for group in _Lines(None, a, b).get_grouped_opcodes(context) if a != b else ():
        lines.append(f"@@ -{_span(group[0][1], group[-1][2])} +{_span(group[0][3], group[-1][4])} @@")
        for tag, i1, i2, j1, j2 in group:
            lines += [" " + l for l in a[i1:i2]] if tag == "equal" else ["-" + l for l in a[i1:i2]] + ["+" + l for l in b[j1:j2]]
    return "\n".join(lines) + "\n" if a != b else ""


def diff_counts(diff: str) -> tuple[int, int, int, int]:
    """added, total, pure, net; a removed line with an added one right after it is one pure change."""
    kinds = [-1 if l.startswith("-") and not l.startswith("---") else 1 if l.startswith("+") and not l.startswith("+++") else 0 for l in diff.split("\n")]
    added, removed = kinds.count(1), kinds.count(-1)
    return added, added + removed, added + removed - sum(p == (-1, 1) for p in pairwise(kinds)), added - removed


def filtered_diff(before: str | None, after: str | None):
    """(diff, added, total, pure, net) between the code of both sides; ('', None, ...) where they are equal."""
    a, b = code_only(before or ""), code_only(after or "")
    diff = unified_diff(a, b, headers=False)
    return (diff, *diff_counts(diff)) if diff else ("", None, None, None, None)


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@.*$", re.M)


def parse_hunks(diff: str) -> list[dict]:
    """Hunks by original start: header, numbers (missing counts are 1) and body lines."""
    marks = [*_HUNK.finditer(diff)]
    out = []
    for m, nxt in zip(marks, [*marks[1:], None], strict=True):
        body = diff[m.end() : nxt.start() if nxt else len(diff)].strip("\n").split("\n")
        a, b, c, d = (int(x) if x else 1 for x in m.groups())
        out.append({"header": m[0], "start": a, "count": b, "new_start": c, "new_count": d, "lines": [l for l in body if not l.startswith("\\")]})
    return sorted(out, key=lambda h: h["start"])


def apply_hunk(lines: list[str], hunk: dict, shift: int) -> list[str] | None:
    """lines after one hunk; None if its old side does not stand where the header says."""
    old = [l[1:] for l in hunk["lines"] if l[:1] in (" ", "-", "")]
    new = [l[1:] for l in hunk["lines"] if l[:1] in (" ", "+", "")]
    at = hunk["start"] - 1 + shift if hunk["count"] else hunk["start"] + shift
    if at < 0 or [l.rstrip() for l in lines[at : at + len(old)]] != [l.rstrip() for l in old]:
        return None
    return lines[:at] + new + lines[at + len(old) :]


_BLANKS = re.compile(r"[ \t]+")
MAX_FUZZ = 2


def _loose(line: str) -> str:
    """A line with each run of blanks as one and none at its end."""
    return _BLANKS.sub(" ", line.rstrip(" \t\r"))


def _place(lines: list[str], old: list[str], said: int) -> int | None:
    """Nearest place to ``said`` where the lines stand."""
    last = len(lines) - len(old)
    if last < 0:
        return None
    said = min(max(said, 0), last)
    for d in range(max(said, last - said) + 1):
        for at in (said + d, said - d) if d else (said,):
            if 0 <= at <= last and lines[at : at + len(old)] == old:
                return at
    return None


def apply_diff(text: str, diff: str, max_fuzz: int = MAX_FUZZ) -> str | None:
    """text after a unified diff, None if it does not apply; of an empty text the added lines.

    Runs of blanks match one another and count for nothing at the end of a line. A hunk that does not stand where its
    header says goes to the nearest place of the whole text where it does; where there is none, up to max_fuzz context
    lines at its ends are left out. Context lines stay as the text has them.
    """
    if not text:
        return "\n".join(l[1:] for l in diff.split("\n") if l.startswith("+") and not l.startswith("+++"))
    lines, shift = text.split("\n"), 0
    loose = [_loose(l) for l in lines]
    for hunk in parse_hunks(diff):
        body = [(l[:1] or " ", l[1:]) for l in hunk["lines"] if l[:1] in (" ", "-", "+", "")]
        head = next((i for i, (s, _) in enumerate(body) if s != " "), len(body))
        tail = next((i for i, (s, _) in enumerate(reversed(body)) if s != " "), 0)
        said = hunk["start"] + shift - (1 if hunk["count"] else 0)
        for fuzz in range(max_fuzz + 1):
            before, after = (min(n, max(0, fuzz + n - max(head, tail))) for n in (head, tail))
            if fuzz and not before and not after:
                continue
            part = body[before : len(body) - after]
            at = _place(loose, [_loose(t) for s, t in part if s != "+"], said + before)
            if at is not None:
                break
        else:
            return None
        new, here = [], at
        for sign, line in part:
            if sign == " ":
                new.append(lines[here])
            elif sign == "+":
                new.append(line)
            here += sign != "+"
        shift += at - (said + before) + len(new) - (here - at)
        lines[at:here] = new
        loose[at:here] = [_loose(l) for l in new]
    return "\n".join(lines)


def split_hunks(before: str, diff: str):
    """Steps (before, after, hunk text) of a diff, one for each hunk, each on the text that the earlier ones left.

    None where hunks overlap or one does not apply.
    """
    hunks = parse_hunks(diff)
    if any(a["start"] + a["count"] - 1 >= b["start"] for a, b in pairwise(hunks)):
        return None
    lines, shift, out = before.split("\n"), 0, []
    for h in hunks:
        done = apply_hunk(lines, h, shift)
        if done is None:
            return None
        out.append(("\n".join(lines), "\n".join(done), "\n".join([h["header"], *h["lines"]])))
        shift += len(done) - len(lines)
        lines = done
    return out


_BLOCK_COMMENT = re.compile(r"/-.*?-/", re.S)


def chunk_new_file(text: str, max_lines: int) -> list[tuple[str, str]]:
    """(before, after) of a new file in steps: cut at blank lines outside block comments, packed up to max_lines."""
    inside = [(m.start(), m.end()) for m in _BLOCK_COMMENT.finditer(text)]
    cuts = [m.start() + 1 for m in re.finditer(r"\n\n", text)]
    cuts = [c for c in cuts if not any(a <= c <= b for a, b in inside)]
    pieces = [text[a:b] for a, b in pairwise([0, *cuts, len(text)]) if a < b]
    packed, size = [], 0
    for piece in pieces:
        n = len(piece.splitlines())
        if packed and size + n <= max_lines:
            packed[-1] += piece
            size += n
        else:
            packed.append(piece)
            size = n
    out, done = [], ""
    for piece in packed:
        out.append((done, done + piece))
        done += piece
    return out


def split_change(before: str | None, after: str | None, diff: str, kind: str, max_lines: int):
    """Rows (before, after, diff, is_split) of one file change under the split policy."""
    pure = diff_counts(diff)[2]
    if pure > max_lines and kind == "created":
        return [(a, b, unified_diff(a, b, headers=False), True) for a, b in chunk_new_file(after or "", max_lines)]
    if pure > max_lines and kind not in ("deleted", "created"):
        steps = split_hunks(before or "", diff)
        if steps:
            return [(a, b, h, True) for a, b, h in steps]
    return [(before, after, diff, False)]


# Fixed values of the source language's lexer, in the order in which they are tried.
DEFINITIONS = frozenset("def definition class inductive coinductive structure abbrev".split())
THEOREMS = frozenset("theorem lemma example".split())
_KEYWORDS = "namespace section end import open export variable variables where by do let".split()
_LEXER = re.compile(
    r"(?P<comment>--[^\n]*(?:\n|$)|/-.*?-/)|(?P<string>\"(?:\\.|[^\\\"])*\")"
    rf"|(?P<definition>\b(?:{'|'.join(sorted(DEFINITIONS | THEOREMS))})\b)|(?P<keyword>\b(?:{'|'.join(_KEYWORDS)})\b)"
    r"|(?P<operator>:=|=|→|⟹|⟸|\+=|-=|\*=|/=|\.\.|≠|≤|≥|[+\-*/%^&|!~])|(?P<punctuation>[:(){}\[\]<>⟨⟩.,;])"
    r"|(?P<identifier>[a-zA-Z_][a-zA-Z0-9_']*)|(?P<space>\s+)|(?P<unknown>.)",
    re.S,
)


def tokens(text: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, value, offset, line, column) without white space, then the end token."""
    out, line, start = [], 1, 0
    for m in _LEXER.finditer(text):
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], m.start(), line, m.start() - start + 1))
        breaks = m[0].count("\n")
        if breaks:
            line += breaks
            start = m.start() + m[0].rindex("\n") + 1
    out.append(("eof", "", len(text), line, len(text) - start + 1))
    return out


_OPENS, _CLOSES = set("({["), set(")}]")


def definitions(text: str) -> list[dict]:
    """Definitions and theorems: kind, keyword, name, first and last line, content."""
    found = tokens(text)
    marks = [i for i, t in enumerate(found) if t[0] == "definition"]
    out = []
    for i, nxt in zip(marks, [*marks[1:], len(found) - 1], strict=True):
        name = next((t[1] for t in found[i + 1 :] if t[0] == "identifier"), "")
        end, depth, proof = nxt - 1, 0, False
        for j in range(i + 1, nxt):
            kind, value = found[j][:2]
            if kind == "punctuation" and value in _OPENS:
                depth += 1
            elif kind == "punctuation" and value in _CLOSES:
                depth = max(0, depth - 1)
            elif not depth and not proof and (value == ":=" or kind == "keyword" and value == "by"):
                proof = True
            elif not depth and proof and kind == "keyword" and value == "end":
                end = max(i, j - 1)
                break
        last = found[end]
        stop = last[2] + len(last[1])
        content = text[found[i][2] : stop].rstrip("\n")
        out.append({"kind": "theorem" if found[i][1] in THEOREMS else "def", "keyword": found[i][1], "name": name, "start": found[i][3], "end": found[i][3] + content.count("\n"), "content": content})
    return out


def changed_lines(before: str, after: str) -> int:
    ops = difflib.SequenceMatcher(None, before.splitlines(), after.splitlines(), autojunk=False).get_opcodes()
    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in ops if tag != "equal")


def added_deleted(before: str, after: str) -> tuple[int, int]:
    """Lines added and deleted; a replaced run counts on both sides."""
    ops = difflib.SequenceMatcher(None, before.splitlines(), after.splitlines(), autojunk=False).get_opcodes()
    return sum(j2 - j1 for t, _, _, j1, j2 in ops if t != "equal"), sum(i2 - i1 for t, i1, i2, _, _ in ops if t != "equal")


KINDS, CHANGES = ("def", "theorem"), ("added", "changed", "deleted")
PAIR_FIELDS = (
    *(f"{side}_total_{k}_count" for side in ("original", "new") for k in KINDS), *(f"{c}_{k}_count" for c in (*CHANGES, "affected") for k in KINDS),
    *(f"{c}_{k}_line_count" for c in CHANGES for k in KINDS), *(f"avg_{c}_{k}_line_count" for c in CHANGES for k in KINDS),
)


def pair_stats(before: str | None, after: str | None) -> dict[str, float]:
    """The 24 statistics of definitions between two versions of a file; of one name the last definition counts."""
    sides = [definitions(before or ""), definitions(after or "")]
    out = dict.fromkeys(PAIR_FIELDS, 0.0)
    for side, found in zip(("original", "new"), sides, strict=True):
        for d in found:
            out[f"{side}_total_{d['kind']}_count"] += 1
    old, new = ({d["name"]: d for d in found} for found in sides)
    for name in old | new:
        a, b = old.get(name), new.get(name)
        if a and b and a["content"] == b["content"]:
            continue
        change = "changed" if a and b else "deleted" if a else "added"
        kind = (a or b)["kind"]
        lines = changed_lines(a["content"], b["content"]) if a and b else (a or b)["content"].count("\n") + 1
        out[f"{change}_{kind}_count"] += 1
        out[f"affected_{kind}_count"] += 1
        out[f"{change}_{kind}_line_count"] += lines
    for c in CHANGES:
        for k in KINDS:
            n = out[f"{c}_{k}_count"]
            out[f"avg_{c}_{k}_line_count"] = out[f"{c}_{k}_line_count"] / n if n else 0.0
    return out


def edit_runs(a: str, b: str, scattered: int = 1) -> tuple[int, int, int]:
    """(scattered, blocks, total) of a shortest character edit script.

    Runs of one operation at consecutive places of up to ``scattered`` characters add their length
    to the first figure, longer ones are blocks. Among shortest scripts the trace prefers match,
    replace, delete, insert; only the total is the same for every choice.
    """
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < top - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ops = _script(a[lo : len(a) - hi], b[lo : len(b) - hi])
    few = blocks = 0
    run, last = 0, None
    for op in [*ops, None]:
        follows = last is not None and op is not None and op[0] == last[0] and op[1] - last[1] == (0 if op[0] == "i" else 1) and op[2] - last[2] == (0 if op[0] == "d" else 1)
        if follows:
            run += 1
        else:
            if last is not None:
                if run <= scattered:
                    few += run
                else:
                    blocks += 1
            run = 1
        last = op
    return few, blocks, len(ops)


def _rows(above: np.ndarray, x: np.ndarray, y: np.ndarray, first: int, swap: int) -> np.ndarray:
    """Rows of the edit table below ``above`` for the characters x, of which the first is number ``first``."""
    ahead, out = np.arange(len(y) + 1, dtype=np.int32), np.empty((len(x) + 1, len(y) + 1), np.int32)
    out[0] = above
    for i, c in enumerate(x, 1):
        row, prev = out[i], out[i - 1]
        row[0] = first + i
        np.minimum(prev[:-1] + swap * (y != c), prev[1:] + 1, out=row[1:])
        np.add(np.minimum.accumulate(row - ahead), ahead, out=row)
    return out


def _script(x: str, y: str, swap: int = 1) -> list[tuple[str, int, int]]:
    """Operations of the traced script, in which a replacement costs ``swap``. Every k-th row of the table is kept, k its height's root; the rows between are made again."""
    n, m = len(x), len(y)
    xs, ys = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (x, y))
    step = max(1, math.isqrt(n))
    kept = [np.arange(m + 1, dtype=np.int32)]
    for lo in range(0, n, step):
        kept.append(_rows(kept[-1], xs[lo : lo + step], ys, lo, swap)[-1].copy())
    out, i, j, lo = [], n, m, n + 1
    rows = None
    while i or j:
        if i and i <= lo:
            lo = (i - 1) // step * step
            rows = _rows(kept[lo // step], xs[lo : lo + step], ys, lo, swap)
        if not i:
            j -= 1
            out.append(("i", i, j))
            continue
        here, above = rows[i - lo], rows[i - lo - 1]
        if j and x[i - 1] == y[j - 1] and here[j] == above[j - 1]:
            i, j = i - 1, j - 1
        elif j and here[j] == above[j - 1] + swap:
            i, j = i - 1, j - 1
            out.append(("r", i, j))
        elif here[j] == above[j] + 1:
            i -= 1
            out.append(("d", i, j))
        else:
            j -= 1
            out.append(("i", i, j))
    return out[::-1]


_WEAK = re.compile(r"--.*?(?:\n|$)|/-.*?-/|#align.*?(?:\n|$)|set_option.*?(?:\n|$)|import.*?(?:\n|$)|open.*?(?:\n|$)", re.S)


def good_edit(before: str | None, after: str | None, scattered: int = 1, max_count: int = 10, max_ratio: float = 0.1, least: int = 10) -> bool:
    """Whether a change is neither tiny nor scattered; a change with an empty side is kept."""
    if not before or not after:
        return True
    a, b = (re.sub(r"\s", "", _WEAK.sub("", t)) for t in (before, after))
    if a == b:
        return False
    few, _, total = edit_runs(a, b, scattered)
    return few <= max_count and few / total < max_ratio and total >= least


# Fixed value: the form in which models write exercises.
_EXERCISE = re.compile(
    r"Exercise[\*\s:]*(\d+)[\*\s]*:[\*\s:]*(.*?)[-\*\s]*Diff Hunk Span.*?@@(.*?)@@.*?[-\*\s]*Task Category[-\*\s:]*(.*?)[-\*\s]*Focus[-\*\s:]*(.*?)"
    r"[-\*\s]*Difficulty[-\*\s:]*(.*?)[-\*\s]*Task Nature[-\*\s:]*(.*?)[-\*\s]*Problem Statement.*?[-\*:]+(.*?)(?=[-\*#\s]*Exercise|$)",
    re.S,
)
EXERCISE_FIELDS = ("num", "title", "hunk_span", "task_category", "focus", "difficulty", "task_nature", "instruction")


def exercises(answer: str | None) -> list[dict] | None:
    """Exercises of a model answer, None if it is cut short or holds none."""
    at = (answer or "").find("Exercises in Lean")
    if at < 0 or "(Continue similarly" in answer:
        return None
    found = [dict(zip(EXERCISE_FIELDS, (int(m[0]), *(x.strip() for x in m[1:])), strict=True)) for m in _EXERCISE.findall(answer[at:].strip(" \n-"))]
    return found or None
