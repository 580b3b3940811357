"""Source files made of whole texts, before and after a known edit, by expressions that Spark and DuckDB share.

Line i of a text becomes a theorem, a definition, a nested comment before a command, a proof step with a string, a line
comment or a blank line; the text's words stay in comments and strings, other signs become _. The edit replaces
lines 6, 26, ... and removes lines 13, 33, ... and a lemma is added at the end. So what each operator must find in
these files is known by counting lines, without the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _words(line: str, g: str) -> str:
    return rf"regexp_replace(regexp_replace({line}, '[^\p{{L}}\p{{N}} ]', '_'{g}), '(?i)open|import|set_option', '_'{g})"


def _line(i: str, line: str, g: str, code: bool = False) -> str:
    """SQL of line i; with code, what is left of it without comments."""
    c = _words(line, g)
    note = "''" if code else f"'-- ' || {c}"
    return (
        f"CASE WHEN {i} % 12 = 4 THEN 'def d' || {i} || ' (x : Nat) : Nat := x ' || {note} WHEN {i} % 4 = 0 THEN 'theorem t' || {i} || ' : True := by trivial ' || {note}"
        f" WHEN {i} % 4 = 1 THEN {f"' #eval x' || {i}" if code else f"'/- ' || {c} || ' /- nested -/ -/ #eval x' || {i}"}"
        f" WHEN {i} % 4 = 2 THEN '  exact s' || {i} || ' \"' || {c} || '\"' WHEN {i} % 8 = 3 THEN {"''" if code else f"'-- ' || {i} || ' ' || {c}"} ELSE '' END"
    )


def _edited(i: str, line: str, g: str) -> str:
    return f"CASE WHEN {i} % 20 = 13 THEN NULL WHEN {i} % 20 = 6 THEN '  exact r' || {i} || ' \"' || {_words(line, g)} || '\"' ELSE {_line(i, line, g)} END"


_LEMMA = "lemma g : 1 = 1 := rfl"

#: CTEs: files (doc_id, n lines, before, after, code: before without comments) and edits (doc_id, replaced, removed, last: whether the last line is removed).
FILES = f"""l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
files AS (SELECT doc_id, len(l) AS n,
  array_to_string(list_transform(l, lambda x, i: {_line('(i - 1)', 'x', ", 'g'")}), chr(10)) || chr(10) AS before,
  array_to_string(list_transform(l, lambda x, i: {_edited('(i - 1)', 'x', ", 'g'")}), chr(10)) || chr(10) || '{_LEMMA}' || chr(10) AS after,
  array_to_string(list_transform(l, lambda x, i: {_line('(i - 1)', 'x', ", 'g'", True)}), chr(10)) || chr(10) AS code FROM l),
edits AS (SELECT doc_id, n, (n + 13) // 20 AS replaced, (n + 6) // 20 AS removed, (n - 1) % 20 = 13 AS last FROM files)"""

#: CTE over FILES: one row for each definition of a new file: doc_id, i, kind, keyword, name.
DEFINED = f"""defined AS (SELECT doc_id, i, CASE WHEN i % 12 = 4 THEN 'def' ELSE 'theorem' END AS kind, CASE WHEN i % 12 = 4 THEN 'def' ELSE 'theorem' END AS keyword, CASE WHEN i % 12 = 4 THEN 'd' ELSE 't' END || i AS name
  FROM (SELECT doc_id, unnest(generate_series(0, n - 1, 4)) AS i FROM files) UNION ALL SELECT doc_id, n, 'theorem', 'lemma', 'g' FROM files)"""


def files(documents: DataFrame) -> DataFrame:
    """documents -> doc_id, lang, before, after."""
    lines = "split(coalesce(text, ''), '\n', -1)"
    escaped = lambda sql: sql.replace("\\", "\\\\")
    before = F.expr(escaped(f"array_join(transform({lines}, (x, i) -> {_line('i', 'x', '')}), '\n') || '\n'"))
    after = F.expr(escaped(f"array_join(transform({lines}, (x, i) -> {_edited('i', 'x', '')}), '\n') || '\n{_LEMMA}\n'"))
    return documents.select("doc_id", "lang", before.alias("before"), after.alias("after"))
