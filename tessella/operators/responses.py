"""Nested model responses: explode, vote, merge verdicts, flatten and filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U
from ..staging import materialise


def exercises_of(rows: DataFrame) -> DataFrame:
    """First response's exercises as a column; responses are dropped."""
    return rows.withColumn("exercises", F.get("responses", F.lit(0))["exercises"]).drop("responses")


def candidates(rows: DataFrame, field: str = "best_gen_content", path: str | None = "file_path_after") -> DataFrame:
    """Distinct (commit_hash, code) of all responses that have code and do not import their own module."""
    each = rows.select("commit_hash", *([path] if path else []), F.explode("responses").alias("r"))
    each = each.where(F.col("r").isNotNull() & F.col(f"r.{field}").isNotNull() & (F.col(f"r.{field}") != ""))
    if path:
        each = each.where(~F.coalesce(T.imports_itself(F.col(path), F.col(f"r.{field}")), F.lit(False)))
    return each.select("commit_hash", F.col(f"r.{field}").alias("code")).distinct()


def best_patch(response: Column) -> Column:
    """The best patch of a response: its own, else after robust repair, after exact repair, as generated."""
    return F.coalesce(response["best_gen_patch"], response["gen_patch_after_robust_repair"], response["gen_patch_after_exact_repair"], response["gen_patch"])


def flatten_complete(rows: DataFrame, lifted: list[str]) -> DataFrame:
    """One row per response with a complete verdict; the fields in ``lifted`` become columns beside the best patch."""
    each = rows.select(*[c for c in rows.columns if c not in ("responses", "best_gen_patch", *lifted)], F.explode("responses").alias("r"))
    each = each.where(F.coalesce(F.col("r.verification_result.complete"), F.lit(False)))
    fields = [F.col(f"r.{f}").alias("raw_patch_generation_responses" if f == "raw_response" else f) for f in lifted if f != "best_gen_patch"]
    return each.select(*[c for c in each.columns if c != "r"], best_patch(F.col("r")).alias("best_gen_patch"), *fields)


def only_verified(rows: DataFrame) -> DataFrame:
    """Rows with their complete responses only; rows without any are dropped."""
    kept = F.filter("responses", lambda r: F.coalesce(r["verification_result"]["complete"], F.lit(False)))
    return rows.withColumn("responses", kept).where(F.size("responses") > 0)


def full_instruction(exercises: Column, given: Column | None = None) -> Column:
    """Numbered tasks with their instructions, unless a full instruction is given."""
    tasks = F.transform(exercises, lambda x, i: F.concat(F.lit("- Task "), (i + 1).cast("string"), F.lit(": "), x["title"], F.lit("\n\n"), x["instruction"]))
    text = F.array_join(tasks, "\n\n\n")
    return text if given is None else F.coalesce(given, text)


def prompt(template_with: str, template_without: str, content: Column, **values: Column) -> Column:
    """A template with its {names} filled in; the second template is used where content is null or empty."""

    def fill(template: str) -> Column:
        out = F.lit(template)
        for name, value in {**values, "content": content}.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
        return out

    return F.when(F.coalesce(content, F.lit("")) == "", fill(template_without)).otherwise(fill(template_with))


def vote(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """keys, majority (ties: the value seen first) and counter (value -> count)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    entry = F.struct(F.col(value).alias("value"), F.col("n"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("majority"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("counter"))


def worst(rows: DataFrame, keys: list[str], value: str, scale: tuple[str, ...]) -> DataFrame:
    """keys and the lowest value on the scale; values off the scale are ignored."""
    level = F.array_position(F.array(*[F.lit(s) for s in scale]), F.col(value))
    return rows.withColumn("__l", level).where("__l > 0").groupBy(*keys).agg(F.min_by(value, "__l").alias("worst"))


def majority_of(values: Column) -> Column:
    """Majority of an array, ties to the value seen first; nulls are ignored."""
    known = F.filter(values, lambda v: v.isNotNull())
    scored = F.transform(F.array_distinct(known), lambda v: F.struct(F.size(F.filter(known, lambda w: w == v)).alias("n"), (-F.array_position(known, v)).alias("p"), v.alias("v")))
    return F.array_max(scored)["v"]


def worst_of(values: Column, scale: tuple[str, ...]) -> Column:
    levels = F.array(*[F.lit(s) for s in scale])
    known = F.filter(F.transform(values, lambda v: F.array_position(levels, v)), lambda p: p > 0)
    return F.try_element_at(levels, F.array_min(known).cast("int"))


def instruction_kept(rows: DataFrame) -> DataFrame:
    """Rows whose majority difficulty and nature are known and neither "very easy" nor "superficial"."""
    return rows.where((F.col("majority_difficulty") != "very easy") & (F.col("majority_task_nature") != "superficial"))


def judged_well(responses: Column) -> Column:
    """More good and excellent grades than poor and unacceptable ones over all responses and tasks.

    "acceptable" counts for neither side; a response without grades counts as none.
    """
    empty = F.lit(None).cast("array<string>")
    grades = F.flatten(F.transform(responses, lambda r: F.coalesce(F.map_values(r["TaskEvaluations"]), F.array().cast("array<string>"), empty)))
    low = F.transform(F.coalesce(grades, F.array().cast("array<string>")), F.lower)
    count = lambda *names: F.size(F.filter(low, lambda g: g.isin(*names)))
    return count("good", "excellent") > count("poor", "unacceptable")


def verified(rows: DataFrame, column: str = "verification_result", key: str = "complete") -> DataFrame:
    return rows.where(F.coalesce(F.col(column)[key], F.lit(False)))


def merge_verdicts(rows: DataFrame, verdicts: DataFrame, keys: list[str], code: str, order: str, result: Column, missing: Column) -> DataFrame:
    """rows with responses -> the same with a verdict in each response.

    verdicts has keys, ``code`` and ``order``; of several for one candidate the last wins. Responses
    without one get ``missing``, null responses stay null, and rows where none matched are dropped.
    ``result`` is an expression over verdicts.
    """
    built = verdicts.groupBy(*keys, code).agg(F.max_by(result, order).alias("__verdict"))
    # The row number ties the exploded responses of a row together again; written out, it is the same in both branches.
    numbered = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
    each = numbered.select("__row", *keys, F.posexplode("responses").alias("__pos", "__r"))
    joined = each.join(built.withColumnRenamed(code, "__code"), [*[each[k].eqNullSafe(built[k]) for k in keys], F.col(f"__r.{code}") == F.col("__code")], "left").select("__row", "__pos", "__r", "__verdict")
    filled = F.when(F.col("__r").isNotNull(), F.col("__r").withField("verification_result", F.coalesce("__verdict", missing)))
    back = joined.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__pos", filled.alias("r")))).alias("__all"), F.bool_or(F.col("__verdict").isNotNull()).alias("__hit"))
    out = numbered.join(back.where("__hit"), "__row").withColumn("responses", F.transform("__all", lambda x: x["r"]))
    return out.drop("__row", "__all", "__hit")


def ratio_of(part: Column, whole: Column) -> Column:
    """Share of a part, null for an empty whole."""
    return F.try_divide(part, whole)


def metadata_from_name(path: Column) -> Column:
    """struct<ts, input, model, temperature> from ``ts__input__model__temp.ext``; null if there are fewer parts."""
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "__")
    made = F.struct(F.get(parts, F.lit(0)).alias("ts"), F.get(parts, F.lit(1)).alias("input"), F.get(parts, F.lit(2)).alias("model"), F.get(parts, F.lit(3)).try_cast("double").alias("temperature"))
    return F.when(F.size(parts) >= 4, made)


def output_file(outputs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (model, input, temperature) with the first file, by name, that fits each."""
    first = outputs.groupBy("model", "input", "temperature").agg(F.min("path").alias("path"))
    return wanted.join(first, ["model", "input", "temperature"], "left")


def repaired(rows: DataFrame, original: str = "content_before", patch: str = "gen_patch") -> DataFrame:
    """rows with ``repair`` (actual patch, content, error, seconds) and ``repaired``, whether the patch could be repaired and applied."""
    out = rows.withColumn("repair", U.timed_repair(F.col(original), F.col(patch)))
    return out.withColumn("repaired", F.col("repair.content").isNotNull())


def repair_stats(rows: DataFrame, key: str = "model") -> DataFrame:
    """Repaired rows -> per model: total, success, time_taken (seconds), failure, rate."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if("repaired").alias("success"), F.sum("repair.seconds").alias("time_taken"))
    return out.withColumn("failure", F.col("total") - F.col("success")).withColumn("rate", F.try_divide(F.col("success").cast("double"), F.col("total")))


def split_repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired rows as the successful ones (repaired_diff, content_after_gen_diff) and the failed ones (error); write rows out first if the repair must run once."""
    fields = rows.drop("repair", "repaired")
    kept = [c for c in fields.columns if c not in ("repaired_diff", "content_after_gen_diff", "error")]
    good = rows.where("repaired").select(*kept, F.col("repair.patch").alias("repaired_diff"), F.col("repair.content").alias("content_after_gen_diff"))
    return good, rows.where("not repaired").select(*kept, F.col("repair.error").alias("error"))


def judged_and_verified(verified_rows: DataFrame, judged_rows: DataFrame, keys: tuple[str, ...] = ("commit_hash", "gold_diff", "content_before")) -> DataFrame:
    """Verified candidates of the tasks that were judged, nulls in keys being equal; judged columns win."""
    left, right = verified_rows.alias("v"), judged_rows.alias("j")
    match = [F.col(f"v.{k}").eqNullSafe(F.col(f"j.{k}")) for k in keys]
    mine = [F.col(f"v.{c}") for c in verified_rows.columns if c in keys or c not in judged_rows.columns]
    return left.join(right, match).select(*mine, *[F.col(f"j.{c}") for c in judged_rows.columns if c not in keys])
