"""Repair of unified diffs with wrong numbers, lost or altered context, or no headers at all.

A diff is read as hunks of (sign, text) lines; numbers in headers are ignored.
Each hunk is placed in the original text, exactly if possible, else by anchors:
hunk lines that resemble original lines, chosen so that the gaps on both sides
agree. Its base lines are then aligned with the text found there, insertions
are put back beside the base lines that they followed, context is trimmed and
topped up from the original, and overlapping hunks are resolved.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field

from . import source_text as S

Line = tuple[str, str]  # sign and text


def normal(line: str) -> str:
    return line.strip(" \n\t·").lower()


def alike(a: str, b: str) -> bool:
    """Whether two normalised lines stand for one another."""
    if a == b or (b.startswith(a) and len(a) > len(b) / 2):
        return True
    x, y = a.split(), b.split()
    return len(x) == len(y) and sum(p != q for p, q in zip(x, y, strict=True)) / max(len(x), 1) < 0.1


@dataclass
class Hunk:
    lines: list[Line] = field(default_factory=list)
    at: int = 0  # first original line, from 0
    old: int = 0
    new: int = 0

    def count(self) -> Hunk:
        self.old = sum(s != "+" for s, _ in self.lines)
        self.new = sum(s != "-" for s, _ in self.lines)
        return self

    @property
    def changes(self) -> int:
        return sum(s != " " for s, _ in self.lines)


def parse(diff: str) -> list[Hunk]:
    """Hunks of a diff; without any header the whole text is one hunk."""
    rows = diff.split("\n")
    if rows and rows[-1] == "":
        rows.pop()

    def signed(row: str) -> Line:
        return (row[0], row[1:]) if row[:1] in ("+", "-", " ") else (" ", row)

    if not any(r.startswith("@@") for r in rows):
        body = [r for r in rows if not r.startswith(("--- ", "+++ "))]
        return [Hunk([signed(r) for r in body])] if body else []
    out: list[Hunk] = []
    for row in rows:
        if row.startswith("@@"):
            out.append(Hunk())
            rest = row.split("@@", 2)
            if len(rest) > 2 and rest[2].strip():
                out[-1].lines.append((" ", rest[2][1:] if rest[2].startswith(" ") else rest[2]))
        elif out and not row.startswith("\\"):
            out[-1].lines.append(signed(row))
    return [h for h in out if h.lines]


def find_exact(base: list[str], original: list[str], start: int) -> int | None:
    first = [i for i in range(start, len(original) - len(base) + 1) if original[i] == base[0]] if base else []
    return next((i for i in first if original[i : i + len(base)] == base), None)


def find_anchors(base: list[Line], original: list[str], start: int, share: float) -> tuple[int, int] | None:
    """First line and end of the region that the base lines resemble; None if too few of them do.

    A shortest-path search over (hunk line, original line) anchors adds the differences of the gaps;
    of equal costs the path on which more lines are the same, not only alike, wins, then the first in the text.
    """
    normals = [normal(l) for l in original]
    wanted = [(i, normal(t)) for i, (_, t) in enumerate(base) if t.strip()]
    columns = []
    for i, text in wanted:
        hits = [(j, int(normals[j] != text)) for j in range(start, len(original)) if normals[j] and alike(text, normals[j])]
        if hits:
            columns.append((i, hits))
    if not columns or len(columns) < max(1, -(-len(wanted) * share // 1)):
        return None
    best = {j: (0, other, j, j) for j, other in columns[0][1]}
    for (i0, _), (i, hits) in zip(columns, columns[1:]):
        step = {}
        for j, other in hits:
            step[j] = min((cost + abs((j - k) - (i - i0)), others + other, min(lo, j), max(hi, j)) for k, (cost, others, lo, hi) in best.items())
        best = step
    _, _, lo, hi = min(best.values())
    return lo, hi + 1


def rebuild(hunk: Hunk, region: list[str]) -> list[Line]:
    """The hunk's lines over the text that stands in the region; insertions stay behind their base line.

    An insertion that a blank base line set apart, which the region lacks, is set apart by a blank line again.
    """
    base: list[Line] = []
    extra: dict[int, list[str]] = {}
    for sign, text in hunk.lines:
        if sign == "+":
            extra.setdefault(len(base) - 1, []).append(text)
        else:
            base.append((sign, text))
    out: list[Line] = [("+", t) for t in extra.get(-1, [])]
    keys = [normal(t) for _, t in base], [normal(t) for t in region]
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        n = max(i2 - i1, j2 - j1)
        for k in range(n):
            i, j = i1 + k, j1 + k
            if j < j2:
                sign = base[i][0] if i < i2 else " "
                out.append((sign, region[j]))
            if i < i2 and i in extra:
                first = extra[i][0]
                if first.strip() and not base[i][1].strip() and out and out[-1][0] != "-" and out[-1][1].strip():
                    out.append(("+", ""))
                out += [("+", t) for t in extra[i]]
    return out


def trim(lines: list[Line], at: int, end: int, original: list[str], context: int) -> tuple[list[Line], int]:
    """Lines with ``context`` unchanged lines at either end, cut or taken from the original; and the first line's place."""
    changed = [i for i, (s, _) in enumerate(lines) if s != " "]
    if not changed:
        return lines, at
    head, tail = changed[0], len(lines) - 1 - changed[-1]
    if head > context:
        lines, at = lines[head - context :], at + head - context
    else:
        more = original[max(0, at - (context - head)) : at]
        lines, at = [(" ", t) for t in more] + lines, at - len(more)
    if tail > context:
        lines = lines[: len(lines) - (tail - context)]
    else:
        lines = lines + [(" ", t) for t in original[end : end + context - tail]]
    return lines, at


def resolve(hunks: list[Hunk]) -> list[Hunk]:
    """Hunks by place; of two that overlap the one with more changes stays, of equals that with the larger net."""
    out: list[Hunk] = []
    for h in sorted(hunks, key=lambda x: x.at):
        if out and h.at < out[-1].at + out[-1].old:
            rank = lambda x: (x.changes, abs(x.new - x.old))
            if rank(h) > rank(out[-1]):
                out[-1] = h
            continue
        out.append(h)
    return out


def emit(hunks: list[Hunk], with_header: bool) -> str:
    rows, shift = (["--- a/file", "+++ b/file"] if with_header else []), 0
    for h in hunks:
        old, new = h.at + (h.old > 0), h.at + shift + (h.new > 0)
        rows.append(f"@@ -{old},{h.old} +{new},{h.new} @@")
        rows += [s + t for s, t in h.lines]
        shift += h.new - h.old
    return "\n".join(rows) + "\n"


def repair(original: str, diff: str, share: float = 0.5, context: int = 3) -> tuple[str | None, str | None]:
    """(diff, None), or (None, whole text) if the only hunk adds everything; (None, None) if no hunk finds its place."""
    lines = original.split("\n")
    hunks = parse(diff)
    if len(hunks) == 1 and all(s == "+" or not t.strip() for s, t in hunks[0].lines):
        return None, "\n".join(t for s, t in hunks[0].lines if s == "+")
    placed = []
    for hunk in hunks:
        base = [(s, t) for s, t in hunk.lines if s != "+"]
        if not [t for _, t in base if t.strip()]:
            # Only additions: nothing says where, so they go to the first line.
            at = end = 0
            body = [(s, t) for s, t in hunk.lines if s == "+"]
        else:
            at = find_exact([t for _, t in base], lines, 0)
            if at is not None:
                end, body = at + len(base), list(hunk.lines)
            else:
                region = find_anchors(base, lines, 0, share)
                if region is None:
                    continue
                at, end = region
                body = rebuild(hunk, lines[at:end])
        if not any(s != " " for s, _ in body):
            continue
        body, at = trim(body, at, end, lines, context)
        placed.append(Hunk(body, at).count())
    if not placed:
        return None, None
    header = not any(l.startswith(("---", "+++")) for l in diff.split("\n"))
    return emit(resolve(placed), header), None


def response(original: str | None, answer: str | None) -> dict | None:
    """Fields of a patch answer: generated, repaired and actual diffs and contents; None without a fenced diff."""
    start = (answer or "").find("```diff")
    stop = (answer or "").find("```", start + 7)
    if start < 0 or stop < 0:
        return None
    patch = answer[start + 7 : stop].strip()
    names = (
        "gen_patch", "gen_content_from_scratch", "gen_patch_after_exact_repair", "gen_content_after_exact_repair", "gen_patch_after_robust_repair",
        "gen_content_after_robust_repair", "best_gen_content", "best_gen_patch", "best_gen_patch_comment_free",
    )
    out = dict.fromkeys(names)
    out["gen_patch"] = patch
    base = original or ""
    if not base:
        content = out["gen_content_from_scratch"] = S.apply_diff("", patch)
    else:
        exact, whole = repair(base, patch, share=1.0)
        out["gen_patch_after_exact_repair"], out["gen_content_after_exact_repair"] = exact, whole if whole is not None else exact and S.apply_diff(base, exact)
        robust, whole = repair(base, patch)
        content = whole if whole is not None else robust and S.apply_diff(base, robust)
        out["gen_patch_after_robust_repair"], out["gen_content_after_robust_repair"] = robust, content
        if whole is not None:
            out["gen_content_from_scratch"] = whole
    if content:
        out["best_gen_content"] = content
        out["best_gen_patch"] = S.unified_diff(base, content)
        out["best_gen_patch_comment_free"] = S.unified_diff(S.strip_comments(base), S.strip_comments(content))
    return out
