"""From commits to one row per changed file, split into hunks or chunks where a change is large."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import source_text as S
from ..functions import text as T
from ..functions import udfs as U
from ..schemas import EXPANSION, FILE_CHANGES
from .curation import with_tokens

MAX_LINES = 100


def by_parent(commits: DataFrame) -> DataFrame:
    """One row for each (commit, parent); commits without parents give none."""
    return commits.withColumn("parent", F.explode("parent_commit_hash"))


def classified(raw: DataFrame) -> DataFrame:
    return raw.withColumn("change_type", T.change_type(F.col("file_path_before"), F.col("file_path_after"), F.coalesce("copied", F.lit(False))))


def file_changes(raw: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """raw changes (commit columns, paths, contents, gold_diff, change_type) -> rows of FILE_CHANGES.

    New files over max_lines changes are cut into chunks, other large ones hunk by hunk; each part has
    its own diff and statistics, with and without comments and commands. Rows are split where they are, without a shuffle.
    """
    names = [f.strip().split(" ")[0] for f in FILE_CHANGES.split(",")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = S.split_change(row["content_before"], row["content_after"], row["gold_diff"] or "", row["change_type"], max_lines)
                for before, after, diff, split in parts:
                    stats = dict(zip(("added_lines", "total_changes", "pure_changes", "absolute_added_lines"), S.diff_counts(diff), strict=True))
                    filtered = dict(zip(("filtered_gold_diff", "filtered_added_lines", "filtered_total_changes", "filtered_pure_changes", "filtered_absolute_added_lines"), S.filtered_diff(before, after), strict=True))
                    out.append(row | {"content_before": before, "content_after": after, "gold_diff": diff, "is_split_hunk": split} | stats | filtered)
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(FILE_CHANGES))
    return raw.mapInArrow(run, FILE_CHANGES)


def expansion_stats(commits: DataFrame, raw: DataFrame, final: DataFrame) -> DataFrame:
    """One row: initial_commits, commit_parent_pairs, file_changes, final_file_changes."""
    a = commits.agg(F.count(F.lit(1)).alias("initial_commits"), F.coalesce(F.sum(F.size("parent_commit_hash")), F.lit(0)).cast("long").alias("commit_parent_pairs"))
    b = raw.agg(F.count(F.lit(1)).alias("file_changes"))
    c = final.agg(F.count(F.lit(1)).alias("final_file_changes"))
    one = F.lit(1)
    return a.withColumn("__j", one).join(b.withColumn("__j", one), "__j").join(c.withColumn("__j", one), "__j").drop("__j")


def expansion_totals(batches: DataFrame) -> DataFrame:
    """Statistics of several batches (one row each) as one row."""
    names = [f.strip().split(" ")[0] for f in EXPANSION.split(",")]
    return batches.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])


def with_statistics(rows: DataFrame, key: str, count=T.token_count, made: DataFrame | None = None) -> DataFrame:
    """rows with module, input_tokens, instruction_tokens and the statistics of their definitions, joined by key.

    Columns of these names are replaced; rows whose files cannot be read keep nulls. made gives statistics that a
    cache holds already (key and the fields of pair_stats).
    """
    names = [*S.PAIR_FIELDS, "module", "input_tokens", "instruction_tokens"]
    given = rows.drop(*names)
    if made is None:
        pair = given.select(key, "content_before", "content_after").dropDuplicates([key])
        made = pair.select(key, U.safe_pair_stats(F.col("content_before"), F.col("content_after")).alias("s")).where("s is not null").select(key, "s.*")
    out = given.join(made, key, "left")
    out = with_tokens(out, "content_before", count) if "content_before" in given.columns else out.withColumn("input_tokens", F.lit(0))
    out = with_tokens(out, "full_instruction", count, "instruction_tokens") if "full_instruction" in given.columns else out.withColumn("instruction_tokens", F.lit(0))
    return out.withColumn("module", T.module_of(F.col("file_path_after")) if "file_path_after" in given.columns else F.lit("other"))


def hunk_rows(diffs: DataFrame, column: str) -> DataFrame:
    """diffs and one row per hunk header of a diff column: start, count, new_start, new_count, by original start."""
    pattern = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    part = lambda k: F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(k))
    number = lambda s, empty: F.when(s == "", F.lit(empty)).otherwise(s).cast("int")
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d"))
    hunks = F.transform(zipped, lambda x: F.struct(number(x["a"], "0").alias("start"), number(x["b"], "1").alias("count"), number(x["c"], "0").alias("new_start"), number(x["d"], "1").alias("new_count")))
    return diffs.select("*", F.explode(F.array_sort(hunks)).alias("h")).select(*diffs.columns, "h.*")
