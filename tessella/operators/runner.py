"""Resumable application of external row functions (models, compilers) with bounded retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair as R


@dataclass
class Pipeline:
    """Hooks of an inference pipeline; subclasses give the parts that differ."""

    samples: int = 1

    def get_input(self, row: dict) -> str:
        raise NotImplementedError

    def call(self, prompt: str) -> str | None:
        """The external call; a stub returns a fixed text."""
        raise NotImplementedError

    def parse_response(self, response: str, row: dict) -> dict | None:
        return {"raw_response": response}

    def initial(self, row: dict) -> dict:
        return {}

    def update(self, state: dict, parsed: dict | None) -> dict:
        return state

    def finish(self, state: dict, row: dict) -> dict:
        return state

    def stop(self, responses: list) -> bool:
        return False

    def row(self, row: dict) -> dict:
        """row with its responses (null where an answer cannot be parsed) and the finished metadata."""
        prompt, state, responses = self.get_input(row), self.initial(row), []
        for _ in range(self.samples):
            answer = self.call(prompt)
            parsed = None if answer is None else self.parse_response(answer, row)
            responses.append(parsed)
            state = self.update(state, parsed)
            if self.stop(responses):
                break
        return {**row, **self.finish(state, row), "responses": responses}


@dataclass
class PatchPipeline(Pipeline):
    """Patches for a row's content: prompt from templates, answers parsed, repaired and applied."""

    model: str = ""
    template: str = "{content}\n\n{full_instruction}"
    template_without: str = "{full_instruction}"

    def get_input(self, row: dict) -> str:
        text = self.template if row.get("content_before") else self.template_without
        for name in ("content_before", "full_instruction"):
            text = text.replace("{" + name.replace("content_before", "content") + "}", row.get(name) or "")
        return text

    def parse_response(self, response: str, row: dict) -> dict | None:
        fields = R.response(row.get("content_before"), response)
        return fields and {**fields, "raw_response": response, "model": self.model}


@dataclass
class Submission(PatchPipeline):
    """Per-row generation of a submission: the first sample with a whole new content ends the row."""

    def stop(self, responses: list) -> bool:
        return bool(responses and responses[-1] and responses[-1].get("best_gen_content"))

    def finish(self, state: dict, row: dict) -> dict:
        return {"model_name": self.model}


def with_retries(function: Callable, times: int = 5, first: float = 1.0, most: float = 60.0, jitter: float = 2.0, sleep=time.sleep):
    """function, tried again after exponentially growing pauses."""

    def call(*args):
        for attempt in range(times):
            try:
                return function(*args)
            except Exception:
                if attempt == times - 1:
                    raise
                sleep(min(most, first * 2**attempt) + random.uniform(0, jitter))

    return call


def provider(model: str, routes: list[tuple[str, str]], default: str) -> str:
    """Provider of a model: that of the first route whose text the model's name contains."""
    return next((p for part, p in routes if part in model.lower()), default)


def parameters(model: str, temperature: float, max_tokens: int, fixed_temperature: tuple[str, ...] = (), thinking: dict[str, int] | None = None) -> dict:
    """Call parameters of a model: those in fixed_temperature take none, those in thinking a token budget."""
    out = {"model": model, "max_tokens": max_tokens}
    if not any(f in model for f in fixed_temperature):
        out["temperature"] = temperature
    if thinking and model in thinking:
        out["thinking"] = {"type": "enabled", "budget_tokens": thinking[model]}
        out.pop("temperature", None)
    return out


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def apply_rows(rows: DataFrame, function: Callable[[dict], dict], schema: str, threads: int = 1, error: str | None = None) -> DataFrame:
    """function over each row as a dict, in so many threads a task.

    Rows on which it raises are left out, or with ``error`` kept with the message in that column, which the schema names.
    """

    def guarded(row: dict) -> dict | None:
        try:
            return function(row)
        except Exception as e:  # noqa: BLE001 - a failed row is tried again
            return None if error is None else {**row, error: f"{type(e).__name__}: {e}"}

    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]

    def run(frames):
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                out = [r for r in pool.map(guarded, frame.to_dict("records")) if r is not None]
                yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names, dtype=object)

    return rows.mapInPandas(run, schema)


def outcomes(done: DataFrame, error: str = "error") -> DataFrame:
    """One row: processed and errors of rows that apply_rows kept with their errors, and the success rate."""
    out = done.agg(F.count_if(F.col(error).isNull()).alias("processed"), F.count_if(F.col(error).isNotNull()).alias("errors"))
    return out.withColumn("success_rate", F.try_divide(F.col("processed").cast("double"), F.col("processed") + F.col("errors")))


def run_resumable(rows: DataFrame, function: Callable[[dict], dict], schema: str, path: str, key: str, max_retries: int = 3) -> DataFrame:
    """Apply function to the rows that the output folder lacks, appending as JSON, up to max_retries + 1 rounds; the leftovers.

    Rounds are idempotent: what a lost round has written is not done again.
    """
    spark = rows.sparkSession

    def written() -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).json(path)

    left = pending(rows, written(), key)
    for _ in range(max_retries + 1):
        if left.isEmpty():
            break
        apply_rows(left, function, schema).write.mode("append").option("ignoreNullFields", "false").json(path)
        left = pending(rows, written(), key)
    return left


def by_group(rows: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function once per group (restore, check all its rows, clean up). Groups must fit a task: key them by commit and slice."""
    return rows.groupBy(*keys).applyInPandas(function, schema)


def sliced(rows: DataFrame, key: str, per_slice: int, order: str) -> DataFrame:
    """rows with a slice number, so that groups of (key, slice) hold about per_slice rows each."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / per_slice).cast("int").alias("__slices"))
    return rows.join(sizes, key).withColumn("slice", F.pmod(F.xxhash64(order), F.col("__slices")).cast("int")).drop("__slices")


def completed_files(progress: DataFrame) -> DataFrame:
    """progress (model, completed, output_files) -> model, file of completed models."""
    return progress.where("completed").select("model", F.explode("output_files").alias("file"))


def next_config(progress: DataFrame, configs: DataFrame) -> DataFrame:
    """configs (model, position) that are still to run: of unfinished models, after the last completed one."""
    state = progress.select("model", "completed", "last_completed_config")
    joined = configs.join(state, "model", "left")
    return joined.where(~F.coalesce("completed", F.lit(False)) & (F.col("position") > F.coalesce("last_completed_config", F.lit(-1)))).select(configs.columns)


def save_missing(left: DataFrame, path: str, key: str) -> int:
    """Write the keys of rows that failed for good as JSON lines of missing_index; how many there are."""
    left.select(F.col(key).alias("missing_index")).write.mode("overwrite").json(path)
    return left.sparkSession.read.json(path, schema="missing_index string").count()


def upsert_progress(old: DataFrame, new: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Progress documents (key, value, updated_at): whole values of new replace those of old, of the keys in ``only`` if given."""
    fresh = new if only is None else new.where(F.col("key").isin(only) | (F.col("key") == "last_updated"))
    both = old.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    return both.groupBy("key").agg(F.max_by(F.struct("value", "updated_at"), F.struct("__new", "updated_at")).alias("x")).select("key", "x.*")


def register_outputs(progress: DataFrame, configs: DataFrame) -> DataFrame:
    """Progress of every model of configs (model, position, path): the output files of all configs are named before they are run."""
    planned = configs.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("position", "path"))).alias("p")).select("model", F.transform("p", lambda x: x["path"]).alias("planned"))
    joined = planned.join(progress, "model", "full_outer")
    known = F.coalesce("output_files", F.array().cast("array<string>"))
    files = F.array_union(known, F.coalesce("planned", F.array().cast("array<string>")))
    return joined.select("model", F.coalesce("completed", F.lit(False)).alias("completed"), F.coalesce("last_completed_config", F.lit(-1)).alias("last_completed_config"), files.alias("output_files"))


def record_config(progress: DataFrame, model: str, position: int, configs: DataFrame) -> DataFrame:
    """progress after a config has run; a model is completed with the last of its configs."""
    last = configs.groupBy("model").agg(F.max("position").alias("__last"))
    mine = F.col("model") == model
    done = F.when(mine, F.greatest("last_completed_config", F.lit(position))).otherwise(F.col("last_completed_config"))
    return progress.join(last, "model", "left").withColumn("last_completed_config", done).withColumn("completed", F.col("completed") | mine & (F.lit(position) >= F.col("__last"))).drop("__last")


def dealt(rows: DataFrame, tasks: int, by: str | None = None) -> DataFrame:
    """rows spread over tasks at random, or the groups of a column by hash, so that no task has all the slow ones."""
    return rows.repartition(tasks) if by is None else rows.repartition(tasks, by)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, made and written there if it is not yet complete."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_name(*parts: Column) -> Column:
    """Name of a run: its time, its parts and an id, joined as file names are."""
    return F.concat_ws("__", F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"), *parts, F.uuid())
