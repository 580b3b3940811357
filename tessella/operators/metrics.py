"""pass@k tables from verified or judged candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CONFIG = ("model", "temperature", "n_responses")


def counts_by_task(rows: DataFrame, task: list[str], correct: Column, config: list[str] = CONFIG) -> DataFrame:
    """rows of candidates -> one row per configuration and task: n, c."""
    return rows.groupBy(*config, *task).agg(F.count(F.lit(1)).alias("n"), F.count_if(correct).alias("c"))


def best_value(has_best: bool) -> Column:
    return F.col("best_gen_patch") if has_best else F.col("gen_patch")


def max_k(n: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1), F.floor(n * ratio)).cast("int")


def pass_at_k(tasks: DataFrame, total: int | None = None, ratio: float = 0.8, config: list[str] = CONFIG, n: str = "n_responses", c: str = "c") -> DataFrame:
    """One row per configuration and k = 1..max(1, n * ratio): k, pass_at_k.

    Tasks without a candidate count as 0: the mean is over max(total, tasks seen). Tasks alike in n and c are counted
    before any k is made, so rows grow with the distinct (n, c), not with tasks.
    """
    alike = tasks.groupBy(*dict.fromkeys([*config, n, c])).agg(F.count(F.lit(1)).alias("__tasks"))
    each = alike.withColumn("k", F.explode(F.sequence(F.lit(1), max_k(F.col(n), ratio)))).withColumn("p", T.pass_at_k(F.col(n), F.col(c), F.col("k")))
    denominator = F.greatest(F.lit(total or 0), F.sum("__tasks"))
    return each.groupBy(*config, "k").agg((F.sum(F.col("p") * F.col("__tasks")) / denominator).alias("pass_at_k"))


def single_k(tasks: DataFrame, total: int | None = None, ratio: float = 0.8, config: list[str] = CONFIG, n: str = "n_responses", c: str = "c") -> DataFrame:
    """Only k = int(n * ratio) of each configuration."""
    full = pass_at_k(tasks, total, ratio, config, n, c)
    return full.where(F.col("k") == max_k(F.col(n), ratio)) if n in config else full


def complete_grid(found: DataFrame, configured: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Every configured (model, temperature, n_responses) and k, 0 where nothing was found; models that
    are found but not configured stay."""
    grid = configured.withColumn("k", F.explode(F.sequence(F.lit(1), max_k(F.col("n_responses"), ratio))))
    return grid.join(found, [*CONFIG, "k"], "full_outer").withColumn("pass_at_k", F.coalesce("pass_at_k", F.lit(0.0)))


def nested(metrics: DataFrame) -> DataFrame:
    """One row per model: map of "temperature,n" to a map of "pass@k_of_n" to value, as the JSON sink writes it."""
    entry = F.struct(F.concat(F.lit("pass@"), F.col("k"), F.lit("_of_"), F.col("n_responses")).alias("key"), F.col("pass_at_k").alias("value"))
    setting = F.concat_ws(",", F.col("temperature").cast("string"), F.col("n_responses").cast("string"))
    inner = metrics.groupBy("model", setting.alias("setting")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values"))
    return inner.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("setting", "values")), lambda a, b: F.when(a["setting"] < b["setting"], -1).when(a["setting"] > b["setting"], 1).otherwise(0))).alias("metrics"))


def labels_of(*metrics: DataFrame) -> DataFrame:
    """Distinct models over several metric tables."""
    out = metrics[0].select("model")
    for m in metrics[1:]:
        out = out.unionByName(m.select("model"))
    return out.distinct()


def series(metrics: DataFrame) -> DataFrame:
    """Curve of each configuration: its points (k, value) by ascending k."""
    return metrics.groupBy(*CONFIG).agg(F.array_sort(F.collect_list(F.struct("k", F.col("pass_at_k").alias("value")))).alias("points"))


def markdown(metrics: DataFrame, percent: bool = False) -> str:
    """Table of metrics; the number of configurations and k bounds what the driver sees."""
    rows = metrics.orderBy(*CONFIG, "k").collect()
    out = ["| model | temperature | n | k | pass@k |", "| --- | --- | --- | --- | --- |"]
    for r in rows:
        out.append(f"| {r.model} | {r.temperature} | {r.n_responses} | {r.k} | {r.pass_at_k:.2%} |" if percent else f"| {r.model} | {r.temperature} | {r.n_responses} | {r.k} | {r.pass_at_k:.4f} |")
    return "\n".join(out)


def save_json(metrics: DataFrame, path: str) -> None:
    """The metrics of each model as one line of JSON, nested as ``nested`` makes them."""
    nested(metrics).coalesce(1).write.mode("overwrite").json(path)
