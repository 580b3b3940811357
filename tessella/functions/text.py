"""Column functions over commit messages, paths, diffs, model answers and compiler output.

All are compositions of built-in functions, so they stay inside code generation
and reach the optimizer as plain expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "(?U)\\s+"
# Kept commit types and spellings that stand for one of them; grade scales, lowest first.
COMMIT_TYPES = ("chore", "feat", "refactor", "fix")
COMMIT_TYPOS = ("faet", "feature", "featl", "feeat")
DIFFICULTY = ("very easy", "easy", "medium", "hard", "very hard")
NATURE = ("superficial", "substantial")
GRADES = ("unacceptable", "poor", "acceptable", "good", "excellent")


def strip_all(text: Column) -> Column:
    """text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def commit_type(message: Column) -> Column:
    """Type of a commit message, or null if it is none of the kept ones.

    The prefix ends before the first of ``: ( ) /``, but only if all four occur;
    otherwise it is the message without its last character.
    """
    first = F.least(*[F.locate(c, message) for c in (":", "(", ")", "/")]) - 1
    prefix = F.when(first < 0, F.substring(message, F.lit(1), F.greatest(F.length(message) - 1, F.lit(0)))).otherwise(F.substring(message, F.lit(1), first))
    word = F.lower(strip_all(prefix))
    word = F.when(word.isin(*COMMIT_TYPOS), "feat").otherwise(word)
    return F.when(word.isin(*COMMIT_TYPES), word)


def change_type(before: Column, after: Column, copied: Column | None = None) -> Column:
    kind = (
        F.when(before.isNull() & after.isNull(), "unknown").when(before.isNull(), "created").when(after.isNull(), "deleted")
        .when(before != after, "renamed").otherwise("modified")
    )
    return kind if copied is None else F.when(copied, "copied").otherwise(kind)


def module_of(path: Column) -> Column:
    return F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("other"))


def strip_noncode(text: Column) -> Column:
    """text without #align, set_option, import and open up to the line's end, wherever they begin; comments stay."""
    return F.regexp_replace(text, r"(?sdU)#align.*?(\n|$)|set_option.*?(\n|$)|import.*?(\n|$)|open.*?(\n|$)|^\s*$\n", "")


def strip_for_distance(text: Column) -> Column:
    """text without comments (not nested), the same commands and all white space."""
    bare = F.regexp_replace(text, r"(?sd)--.*?(\n|$)|/-.*?-/|#align.*?(\n|$)|set_option.*?(\n|$)|import.*?(\n|$)|open.*?(\n|$)", "")
    return F.regexp_replace(bare, r"(?U)\s", "")


def diff_stats(diff: Column) -> Column:
    """struct<added, total, pure, net> of a unified diff's lines; a removed line followed by an added one is one change."""
    kinds = F.transform(
        F.split(F.coalesce(diff, F.lit("")), "\n"),
        lambda l: F.when(l.startswith("-") & ~l.startswith("---"), -1).when(l.startswith("+") & ~l.startswith("+++"), 1).otherwise(0),
    )
    count = lambda k, v: F.size(F.filter(k, lambda x: x == v))

    def finish(k: Column) -> Column:
        added, removed = count(k, 1), count(k, -1)
        pairs = F.zip_with(k, F.slice(k, F.lit(2), F.size(k)), lambda a, b: F.coalesce((a == -1) & (b == 1), F.lit(False)))
        replaced = F.size(F.filter(pairs, lambda x: x))
        return F.struct(added.alias("added"), (added + removed).alias("total"), (added + removed - replaced).alias("pure"), (added - removed).alias("net"))

    return F.element_at(F.transform(F.array(kinds), finish), 1)


def repeat_ratios(diff: Column) -> Column:
    """struct<added, removed>: distinct share of trimmed non-empty lines on each side; 1 where there are none."""
    lines = F.split(F.coalesce(diff, F.lit("")), "\n")

    def share(sign: str) -> Column:
        side = F.filter(lines, lambda l: l.startswith(sign))
        side = F.filter(F.transform(side, lambda l: strip_all(F.substring(l, F.lit(2), F.length(l)))), lambda l: l != "")
        return F.coalesce(F.try_divide(F.size(F.array_distinct(side)), F.size(side)), F.lit(1.0))

    return F.struct(share("+").alias("added"), share("-").alias("removed"))


def distinct_line_ratio(text: Column) -> Column:
    """Share of distinct lines among the trimmed non-empty lines of a text; 1 where there are none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip_all), lambda l: l != "")
    return F.coalesce(F.try_divide(F.size(F.array_distinct(lines)), F.size(lines)), F.lit(1.0))


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, "^[ \n\t·]+|[ \n\t·]+$", ""))


def anchor_match(a: Column, b: Column) -> Column:
    """Whether two normalised lines stand for one another: equal, a long prefix, or nearly all words equal in place."""
    words = lambda l: F.filter(F.split(l, BLANK), lambda w: w != "")
    wa, wb = words(a), words(b)
    differ = F.size(F.filter(F.zip_with(wa, wb, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    near = (F.size(wa) == F.size(wb)) & (differ / F.greatest(F.size(wa), F.lit(1)) < 0.1)
    return (a == b) | (b.startswith(a) & (F.length(a) > F.length(b) / 2)) | near


def token_count(text: Column) -> Column:
    """Offline token count: runs of letters or digits and single signs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")), F.lit(0))


def compiler_lines(output: Column) -> Column:
    """array<struct<type, message>> of the non-empty lines of compiler output."""
    lines = F.filter(F.transform(F.split(F.coalesce(output, F.lit("")), "\n"), strip_all), lambda l: l != "")
    kind = lambda l: F.when(F.lower(l).contains("error"), "error").when(F.lower(l).contains("warning"), "warning").otherwise("info")
    return F.transform(lines, lambda l: F.struct(kind(l).alias("type"), l.alias("message")))


def verdict(lines: Column, returncode: Column) -> Column:
    """struct<pass, complete>: no error and exit code 0, and no warning either."""
    ok = F.coalesce((returncode == 0) & ~F.exists(lines, lambda l: l["type"] == "error"), F.lit(False))
    return F.struct(ok.alias("pass"), (ok & ~F.exists(lines, lambda l: l["type"] == "warning")).alias("complete"))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def storage_path(digest: Column) -> Column:
    return F.concat_ws("/", F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def judgement_json(answer: Column) -> Column:
    """JSON text of an answer: the last fenced json block, else the widest braces around "TaskEvaluations"."""
    fenced = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"(?s)```json(.*?)```"), F.lit(1)), F.lit(-1))
    bare = F.regexp_extract(answer, r'(?s)\{.*"TaskEvaluations".*\}', 0)
    return strip_all(F.coalesce(fenced, F.when(bare != "", bare)))


def parse_judgement(answer: Column) -> Column:
    """struct<TaskEvaluations, FinalOverallGrade>, null if the answer holds none."""
    parsed = F.from_json(judgement_json(answer), "TaskEvaluations map<string,string>, FinalOverallGrade string")
    return F.when(parsed["TaskEvaluations"].isNotNull(), parsed)


def fenced_diff(answer: Column) -> Column:
    found = F.regexp_extract_all(answer, F.lit(r"(?s)```diff(.*?)```"), F.lit(1))
    return strip_all(F.try_element_at(found, F.lit(1)))


def fenced_code(answer: Column) -> Column:
    """Inside of the last fenced block (an open one counts), without first and last line and ``line N`` marks."""
    closed = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"(?s)```.*```"), F.lit(0)), F.lit(-1))
    open_ = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"(?s)```.*"), F.lit(0)), F.lit(-1))
    lines = F.split(strip_all(F.coalesce(closed, open_, answer)), "\n")
    return F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"), "line [0-9]* ", "")


def display_name(model: Column, names: dict[str, str]) -> Column:
    """Name to show for a model, the model itself if it has none."""
    if not names:
        return model
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, model), model)


def series_label(model: Column, temperature: Column, names: dict[str, str], plain: tuple[str, ...] = ()) -> Column:
    """Label of a curve; models in ``plain`` take no temperature."""
    shown = display_name(model, names)
    return F.when(model.isin(*plain) if plain else F.lit(False), shown).otherwise(F.concat(shown, F.lit(" (T="), temperature.cast("string"), F.lit(")")))


def imports_itself(path: Column, content: Column) -> Column:
    """Whether content imports the module of its own path; dots of the module match any character."""
    module = F.regexp_replace(F.regexp_replace(path, r"\.lean$", ""), "/", ".")
    return F.regexp_like(content, F.concat(F.lit(r"import\s+"), module, F.lit(r"(\s|$)")))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Unbiased estimate of the chance that one of k drawn from n samples, c of them right, is right."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - k / i))
    return F.when((n == 0) | (c == 0), 0.0).when(n - c < k, 1.0).otherwise(1.0 - miss)


def diff_lines(diff: Column) -> Column:
    """Lines of a diff without the sign of added and removed ones."""
    return F.transform(F.split(diff, "\n"), lambda l: F.when(l.startswith("+") | l.startswith("-"), F.substring(l, F.lit(2), F.length(l))).otherwise(l))


def json_text(*values: Column) -> Column:
    """Values as one JSON object: sets and arrays as lists, dates in ISO form, nulls kept."""
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "dateFormat": "yyyy-MM-dd"})


def greyed(colour: Column, share: float) -> Column:
    """A colour #rrggbb mixed with its own grey level, by share."""
    part = lambda k: F.conv(F.substring(colour, k, 2), 16, 10).cast("int")
    grey = 0.299 * part(2) + 0.587 * part(4) + 0.114 * part(6)
    mixed = [F.lpad(F.lower(F.hex(F.round(part(k) * (1 - share) + grey * share).cast("int"))), 2, "0") for k in (2, 4, 6)]
    return F.concat(F.lit("#"), *mixed)
