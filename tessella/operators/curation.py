"""Curation of mined changes: predicates, the stage waterfall, histograms, token limits and ordering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import materialise


@dataclass(frozen=True)
class Limits:
    """Curation parameters."""

    min_changes: int = 1
    max_changes: int = 100
    min_repeat: float = 0.8
    min_absolute: int = 5
    ratio: float = 0.5
    max_tokens: int = 16384
    earliest: str = "2023-08-01"


def kept_path(path: Column, root: str = "Mathlib/", index: str = "Mathlib.lean", suffix: str = ".lean") -> Column:
    return (path != index) & path.startswith(root) & path.endswith(suffix)


def positive_change(pure: Column, added: Column, net: Column, min_absolute: int, ratio: float) -> Column:
    return (pure > 0) & ((net > 0) | ((added > min_absolute) & (net * ratio + added > 0)))


def within_changes(pure: Column, low: int, high: int) -> Column:
    return pure.between(low, high)


def repeats_little(diff: Column, threshold: float) -> Column:
    r = T.repeat_ratios(diff)
    return (r["added"] >= threshold) & (r["removed"] >= threshold)


def stages(limits: Limits = Limits()) -> list[tuple[str, Column, str]]:
    """(name, predicate, description) of the native curation stages over file_changes, in order."""
    return [
        ("commit_type", T.commit_type(F.col("message")).isNotNull(), "type is chore, feat, refactor or fix"),
        ("not_deleted", F.col("change_type") != "deleted", "file exists after the change"),
        ("path", kept_path(F.col("file_path_after")), "library source file"),
        ("positive", positive_change(F.col("filtered_pure_changes"), F.col("filtered_added_lines"), F.col("filtered_absolute_added_lines"), limits.min_absolute, limits.ratio), "adds content"),
        ("size", within_changes(F.col("filtered_pure_changes"), limits.min_changes, limits.max_changes), "neither tiny nor huge"),
        ("repeats", repeats_little(F.col("filtered_gold_diff"), limits.min_repeat), "few repeated lines"),
    ]


def curate(changes: DataFrame, predicates: list[tuple[str, Column, str]]) -> DataFrame:
    """Rows that pass every predicate; native ones reach the scan as one conjunction."""
    for _, keep, _ in predicates:
        changes = changes.where(keep)
    return changes


def waterfall(df: DataFrame, predicates: list[tuple[str, Column, str]], before: list[tuple[str, Column, str]] = ()) -> DataFrame:
    """Rows before and after each stage, in one pass: stage, name, before, after, description.

    A stage sees what all earlier ones kept. ``before`` are expansion stages given as aggregates.
    """
    passed, columns = F.lit(True), [F.count(F.lit(1)).alias("c0")]
    for i, (_, keep, _) in enumerate(predicates, 1):
        passed = passed & F.coalesce(keep, F.lit(False))
        columns.append(F.count_if(passed).alias(f"c{i}"))
    one = df.agg(*columns, *[c.alias(f"x{i}") for i, (_, c, _) in enumerate(before)])
    rows = [F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.col(f"c{i - 1}").alias("before"), F.col(f"c{i}").alias("after"), F.lit(d).alias("description")) for i, (n, _, d) in enumerate(predicates, 1)]
    for i, (n, _, d) in enumerate(before):
        earlier = F.col(f"x{i - 1}") if i else F.col("x0")
        rows.insert(i, F.struct(F.lit(i - len(before)).alias("stage"), F.lit(n).alias("name"), earlier.cast("long").alias("before"), F.col(f"x{i}").cast("long").alias("after"), F.lit(d).alias("description")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def single_parent(changes: DataFrame, drop_merges: bool = False) -> DataFrame:
    """parent_commit_hash as a scalar; a commit with several parents raises, or is dropped."""
    parents = F.col("parent_commit_hash")
    if drop_merges:
        return changes.where(F.size(parents) == 1).withColumn("parent_commit_hash", F.element_at(parents, 1))
    checked = F.when(F.size(parents) == 1, F.element_at(parents, 1)).otherwise(F.raise_error(F.lit("a commit has not exactly one parent")).cast("string"))
    return changes.withColumn("parent_commit_hash", checked)


def with_tokens(df: DataFrame, content: str, count=T.token_count, name: str = "input_tokens") -> DataFrame:
    """df and the token count of a content column; each distinct content is counted once.

    Null and empty contents have no tokens and are not joined, so that they do not meet under one key.
    """
    blank = F.coalesce(content, F.lit("")) == ""
    keyed = df.where(~blank).withColumn("__h", T.content_hash(F.col(content)))
    counted = keyed.select("__h", content).dropDuplicates(["__h"]).select("__h", count(F.col(content)).cast("int").alias(name))
    full = keyed.join(counted, "__h").drop("__h")
    return full.unionByName(df.where(blank).withColumn(name, F.lit(0)))


def token_limit(df: DataFrame, content: str, limit: int, count=T.token_count) -> DataFrame:
    return with_tokens(df, content, count).where(F.col("input_tokens") <= limit)


def instant(date: Column) -> Column:
    """An ISO date with offset as an instant."""
    return F.to_timestamp(date, "yyyy-MM-dd'T'HH:mm:ssXXX")


def since(df: DataFrame, date: str, earliest: str) -> DataFrame:
    """Rows whose ISO date is not before ``earliest``, compared as text."""
    return df.where(F.col(date) >= earliest)


def latest(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows with the greatest keys; ties of all keys may fall either way."""
    return df.orderBy(*[F.desc(k) for k in keys]).limit(n)


def oldest_tail(df: DataFrame, ratio: float, *keys: str) -> DataFrame:
    """The oldest int(rows * (1 + ratio)) rows by the keys, for a ratio from -1 to 0; rows equal in all keys may fall either way.

    Rows are numbered by a range-partitioned sort, so that no task holds more than a range.
    """
    numbered = reindex(df, *keys, name="__index", descending=False)
    total = numbered.agg(F.count(F.lit(1)).alias("__total"))
    return numbered.join(F.broadcast(total)).where(F.col("__index") < F.floor(F.col("__total") * (1 + ratio))).drop("__index", "__total")


def reindex(df: DataFrame, *keys: str, name: str = "index", descending: bool = True) -> DataFrame:
    """Rows numbered from 0 by the keys, descending or ascending; a column of that name is replaced.

    A range-partitioned sort with counts of each range keeps the numbering distributed; a global window would gather all
    rows in one task. The ranges are written out before they are counted: a second evaluation could draw them otherwise.
    """
    spark = df.sparkSession
    order = [(F.desc if descending else F.asc)(k) for k in keys]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each range: the window over them is small.
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    numbered = placed.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__at") - 1).drop("__part", "__at", "__before")


def frequency(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """bin, low, high, n of equal bins over the range, the last one closed; a range of one value is bin 1."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.width_bucket("v", "lo", "hi", F.lit(bins)), F.lit(bins)))
    counts = v.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("hi") - F.col("lo")) / bins
    return counts.select("bin", (F.col("lo") + step * (F.col("bin") - 1)).alias("low"), (F.col("lo") + step * F.col("bin")).alias("high"), "n")


def upper_median(df: DataFrame, value: Column, bins: int = 1024) -> DataFrame:
    """median (of the sorted values that at n div 2), mean, n; nulls are left out.

    Values are counted in equal bins over their range, then in bins within the one that holds the middle; only the
    distinct values of that last bin are put in order, so no task orders all of them.
    """
    v = df.select(value.alias("v")).where("v is not null")
    x = F.col("v").cast("double")
    counts = v.groupBy("v").agg(F.count(F.lit(1)).alias("n"))

    def within(lo: Column, hi: Column) -> Column:
        return F.when(lo == hi, F.lit(1)).otherwise(F.least(F.greatest(F.floor((x - lo) / (hi - lo) * bins) + 1, F.lit(1)), F.lit(bins))).cast("int")

    run = Window.orderBy("bin")
    ends = v.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("all"), F.avg(F.lit(0.0)).alias("before"))
    for _ in range(2):
        # At most ``bins`` rows reach the window.
        held = counts.join(F.broadcast(ends)).where((x >= F.col("lo")) & (x <= F.col("hi"))).withColumn("bin", within(F.col("lo"), F.col("hi")))
        held = held.groupBy("bin").agg(F.sum("n").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.max("all").alias("all"), F.max("before").alias("before"))
        upto = held.withColumn("upto", F.col("before") + F.sum("n").over(run))
        middle = upto.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min_by(F.struct("lo", "hi", "all", (F.col("upto") - F.col("n")).alias("before")), "bin").alias("m"))
        ends = middle.select("m.*")
    last = counts.join(F.broadcast(ends)).where((x >= F.col("lo")) & (x <= F.col("hi"))).withColumn("upto", F.col("before") + F.sum("n").over(Window.orderBy("v")))
    median = last.agg(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("v"))).alias("median"))
    total = counts.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return median.join(total)


def unit_histogram(df: DataFrame, value: Column) -> DataFrame:
    """value, n for each value, with the range and mean of all on every row."""
    counts = df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    everything = counts.agg(F.min("value").alias("low"), F.max("value").alias("high"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    return counts.join(F.broadcast(everything))
