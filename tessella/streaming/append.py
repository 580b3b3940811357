"""Append-as-completed processing as a stream of JSON files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new_files(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Each new row of the folder goes through transform once, by key, and is appended to out as JSON lines.

    The checkpoint makes restarts continue where they stopped. Batches are written under their own
    number with overwrite, so a batch that is repeated after a failure leaves no duplicates.
    """
    rows = spark.readStream.schema(schema).json(folder).dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/batch={number}")

    return transform(rows).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_status(spark: SparkSession, folder: str, schema: str, key: str, order: str, late: str) -> DataFrame:
    """Streaming latest row per key within a bound of lateness."""
    from pyspark.sql import functions as F

    rows = spark.readStream.schema(schema).json(folder).withColumn("at", F.to_timestamp(order)).withWatermark("at", late)
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), "at").alias("row")).select("row.*")
