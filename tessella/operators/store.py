"""Content-addressed artifact store: snapshots, put-if-absent, restore, commit status."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

STATUSES = ("pending", "building", "collapsed", "ready", "failed", "failed_verify")
PROCESSED = ("ready", "collapsed")
#: Status changes that a build and its checks may make; None is a commit that has no status yet.
MOVES = {
    (None, "pending"), ("pending", "building"), ("pending", "collapsed"), ("building", "collapsed"), ("collapsed", "ready"), ("ready", "collapsed"),
    ("pending", "failed"), ("building", "failed"), ("failed", "pending"), ("collapsed", "failed_verify"), ("ready", "failed_verify"), ("failed_verify", "collapsed"),
}
TOLERATED_FAILURES = 10


def snapshot(files: DataFrame) -> DataFrame:
    """files (commit_id, rel_path, type, content) -> commit_id, rel_path, hash, type; a link's content is its target."""
    return files.select("commit_id", "rel_path", T.content_hash(F.col("content")).alias("hash"), "type")


def absent(files: DataFrame, store: DataFrame) -> DataFrame:
    """(hash, path, content) of contents that the store does not hold, each once."""
    fresh = files.select(T.content_hash(F.col("content")).alias("hash"), "content").dropDuplicates(["hash"]).join(store.select("hash"), "hash", "left_anti")
    return fresh.select("hash", T.storage_path(F.col("hash")).alias("path"), "content")


def put(files: DataFrame, folder: str) -> None:
    """Append the contents that the store folder lacks, as a table partitioned by the first two digits of the hash."""
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    old = spark.read.schema("hash string, content binary, fan string").parquet(folder) if there else spark.createDataFrame([], "hash string")
    fresh = absent(files, old.select("hash")).select("hash", "content", F.substring("hash", 1, 2).alias("fan"))
    fresh.repartition("fan").write.mode("append").partitionBy("fan").parquet(folder)


def put_files(contents: DataFrame, uri: str) -> DataFrame:
    """(hash, content) -> hash, written: each content as a file ab/cd/hash below a folder that the executors share, if it is not there yet."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            written = []
            for digest, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{base}/{digest[:2]}/{digest[2:4]}"
                fresh = system.get_file_info(f"{folder}/{digest}").type == fs.FileType.NotFound
                if fresh:
                    system.create_dir(folder)
                    # Renamed when complete, so that a lost task leaves no torn file under the name.
                    part = f"{folder}/.{digest}.{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write(content)
                    system.move(part, f"{folder}/{digest}")
                written.append(fresh)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written, pa.bool_())], names=["hash", "written"])

    return contents.select("hash", "content").mapInArrow(run, "hash string, written boolean")


def present(files: DataFrame, store: DataFrame) -> DataFrame:
    return files.join(store.select("hash"), "hash", "left_semi")


def restore(snapshots: DataFrame, store: DataFrame) -> DataFrame:
    """Files of the snapshots with their content, null where the store lacks it."""
    return snapshots.join(store.select("hash", "content"), "hash", "left").select("commit_id", "rel_path", "type", "hash", "content")


def restore_summary(snapshots: DataFrame, store: DataFrame, tolerated: int = TOLERATED_FAILURES) -> DataFrame:
    """commit_id, files, failed, restored (at most ``tolerated`` failures)."""
    held = snapshots.join(store.select("hash", F.lit(True).alias("held")), "hash", "left")
    out = held.groupBy("commit_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("held").isNull()).alias("failed"))
    return out.withColumn("restored", F.col("failed") <= tolerated)


def sizes(files: DataFrame) -> DataFrame:
    """commit-independent totals: files, logical_bytes, distinct_files, stored_bytes, ratio."""
    per_hash = files.groupBy(T.content_hash(F.col("content")).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("content")).cast("long").alias("size"))
    total = per_hash.agg(F.sum("n").alias("files"), F.sum(F.col("n") * F.col("size")).alias("logical_bytes"), F.count(F.lit(1)).alias("distinct_files"), F.sum("size").alias("stored_bytes"))
    return total.withColumn("ratio", F.try_divide(F.col("logical_bytes").cast("double"), F.col("stored_bytes")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, extras: str | None = None) -> DataFrame:
    """The last row per key by ``order``; maps in ``extras`` are merged, later values over earlier ones."""
    both = old.unionByName(new, allowMissingColumns=True)
    others = [c for c in both.columns if c not in keys and c != extras]
    latest = F.max_by(F.struct(*others), order).alias("__last")
    if extras is None:
        return both.groupBy(*keys).agg(latest).select(*keys, "__last.*")
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.map_entries(F.coalesce(F.col(extras), F.create_map().cast("map<string,string>"))).alias("e"))))
    flat = F.flatten(F.transform("__extras", lambda x: x["e"]))
    # Of several entries of a key the last in order stays.
    backwards = F.reverse(flat)
    names = F.array_distinct(F.transform(backwards, lambda e: e["key"]))
    merged = F.map_from_entries(F.transform(names, lambda n: F.element_at(F.filter(backwards, lambda e: e["key"] == n), 1)))
    return both.groupBy(*keys).agg(latest, entries.alias("__extras")).select(*keys, "__last.*", merged.alias(extras))


def processed(status: Column) -> Column:
    return status.isin(*PROCESSED)


def to_build(commits: DataFrame, status: DataFrame, force: bool = False) -> DataFrame:
    """Commits that are not collapsed yet, or all of them."""
    return commits if force else commits.join(status.where("status = 'collapsed'").select("commit_id"), "commit_id", "left_anti")


def checked_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """new (commit_id, status) with the status before it and whether the move is allowed."""
    before = old.select("commit_id", F.col("status").alias("before"))
    pairs = F.array(*[F.lit(f"{a or ''}>{b}") for a, b in sorted(MOVES, key=str)])
    move = F.concat(F.coalesce("before", F.lit("")), F.lit(">"), F.col("status"))
    return new.join(before, "commit_id", "left").withColumn("allowed", F.array_contains(pairs, move) | F.coalesce(F.col("before") == F.col("status"), F.lit(False)))


def build_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def check_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of passed and complete checks."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pass")).alias("passed"), F.count_if(F.col("complete")).alias("completed"))
    return out.withColumn("pass_rate", F.try_divide(F.col("passed").cast("double"), F.col("n"))).withColumn("complete_rate", F.try_divide(F.col("completed").cast("double"), F.col("n")))


def success_rate(done: Column, errors: Column) -> Column:
    return F.try_divide(done.cast("double"), done + errors)
