"""File sources and sinks: mixed globs, JSON lines, sidecars, status folders, chat logs, configs."""

from __future__ import annotations

import json
import re
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def _kind(path: str) -> str | None:
    return "parquet" if path.endswith(".parquet") else "json" if path.endswith((".json", ".jsonl")) else None


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob names, through the file system of the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in (found or []))


def _torn(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the JSON files that hold a line that is no JSON."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    return [r.path for r in lines.where(F.try_parse_json("value").isNull()).select("path").distinct().collect()]


def load_results(spark: SparkSession, patterns: str | list[str], schema: str | None = None) -> DataFrame:
    """All files of the globs as one table, columns by name, missing ones null; other kinds of files are skipped.

    Corrupt files and JSON files with a bad line are skipped whole; each skipped file is warned of, but for corrupt
    Parquet files, which only their reader meets. Without a schema JSON is inferred, which reads it once more.
    """
    paths = [p for g in ([patterns] if isinstance(patterns, str) else patterns) for p in _matches(spark, g)]
    groups = {k: [p for p in paths if _kind(p) == k] for k in ("parquet", "json", None)}
    torn = _torn(spark, groups["json"]) if groups["json"] else []
    name = lambda p: "/" + p.split(":", 1)[-1].lstrip("/")
    groups["json"] = [p for p in groups["json"] if name(p) not in {name(t) for t in torn}]
    for p in groups[None]:
        warnings.warn(f"{p} is skipped: its format is not supported", stacklevel=2)
    for p in torn:
        warnings.warn(f"{p} is skipped: it has a line that is no JSON", stacklevel=2)
    parts = []
    if groups["parquet"]:
        parts.append(spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(*groups["parquet"]))
    if groups["json"]:
        reader = spark.read.schema(schema) if schema else spark.read
        parts.append(reader.json(groups["json"]))
    if not parts:
        return spark.createDataFrame([], schema or "empty string").select(*([] if schema is None else ["*"]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_one(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One file by its suffix; an unknown one raises, and so does a bad JSON line."""
    kind = _kind(path)
    if kind is None:
        raise ValueError(f"unsupported file format: {path}")
    if kind == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def save(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet or JSON lines, by kind or suffix; JSON keeps nulls and characters beyond ASCII."""
    kind = {"jsonl": "json"}.get(kind, kind) or _kind(path)
    if kind not in ("parquet", "json"):
        raise ValueError(f"unsupported file format: {kind or path}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path) if kind == "parquet" else writer.option("ignoreNullFields", "false").json(path)


def save_with_stats(df: DataFrame, stats: DataFrame, path: str) -> None:
    """Parquet and a folder of one JSON row of expansion statistics beside it."""
    df.write.parquet(path)
    stats.coalesce(1).write.json(path.removesuffix(".parquet") + "_stats.json")


def save_by_commit(rows: DataFrame, path: str, key: str = "commit_hash") -> None:
    """JSON lines in one folder for each commit, each written by one task."""
    rows.repartition(key).write.mode("append").partitionBy(key).option("ignoreNullFields", "false").json(path)


def _footer(spark: SparkSession, path: str, key: str) -> str | None:
    """A value of the key-value metadata in a Parquet file's footer; of a folder in that of its first file."""
    file = next(iter(_matches(spark, f"{path}/*.parquet") or _matches(spark, path)), None)
    if file is None:
        return None
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    try:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
    except Exception:  # noqa: BLE001 - no Parquet file, so no footer
        return None
    try:
        return reader.getFooter().getFileMetaData().getKeyValueMetaData().get(key)
    finally:
        reader.close()


def expansion_stats(spark: SparkSession, path: str, key: str = "expansion_stats") -> DataFrame:
    """The statistics in a table's footer, else those beside it, else 1 for each."""
    if found := _footer(spark, path, key):
        values = json.loads(found)
        names = [f.strip().split(" ")[0] for f in schemas.EXPANSION.split(",")]
        return spark.createDataFrame([tuple(int(values.get(n, 1)) for n in names)], schemas.EXPANSION)
    sidecar = path.removesuffix(".parquet") + "_stats.json"
    if not _matches(spark, sidecar):
        return spark.createDataFrame([(1, 1, 1, 1)], schemas.EXPANSION)
    return spark.read.schema(schemas.EXPANSION).json(sidecar)


def commit_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Status of every commit from a folder of JSON documents."""
    return spark.read.option("multiLine", "true").schema("commit_id string, status string, message string, updated_at string, full_size bigint, build_time double").json(folder)


def json_array(spark: SparkSession, path: str, schema: str, limit: int | None = 10) -> DataFrame:
    out = spark.read.option("multiLine", "true").schema(schema).json(path)
    return out if limit is None else out.limit(limit)


def chat_history(spark: SparkSession, folder: str, day: str, thread_id: int | None = None) -> DataFrame:
    """Log rows of a day; the folder is partitioned by day, so other days are not read."""
    rows = spark.read.schema(schemas.CHAT_LOG).json(folder).where(F.col("day") == day)
    return rows if thread_id is None else rows.where(F.col("thread_id") == thread_id)


def append_chat(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").partitionBy("day").json(folder)


def verify_groups(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Checked input of verification: every row has code; null code raises. The rows of a commit come to one task, commits to tasks by hash."""
    code = F.when(F.col("code").isNull(), F.raise_error(F.lit("a record has no code")).cast("string")).otherwise(F.col("code"))
    checked = rows.withColumn("code", code)
    return checked.repartition("commit_hash") if tasks is None else checked.repartition(tasks, "commit_hash")


def toolchains(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_replace("toolchain_content", r"(?U)^\s+|\s+$", "").alias("toolchain")).where("toolchain <> ''").distinct()


def latest_folder(spark: SparkSession, pattern: str) -> str | None:
    """The path of a glob that changed last; file systems of a cluster keep no time of creation."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max(((s.getModificationTime(), s.getPath().toString()) for s in found), default=(0, None))[1]


def merge_config(base: dict, over: dict) -> dict:
    """base with the values of over, nested dicts merged; neither is changed."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge_config(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_config(text: str, kind: str = "json") -> dict:
    """Configuration from JSON or YAML; without a YAML reader, from the YAML that read_yaml knows."""
    if kind == "json":
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        return read_yaml(text)
    return yaml.safe_load(text)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1].replace("''", "'") if text[0] == "'" else json.loads(text)
    if text[:1] in ("[", "{"):
        inner = text[1:-1].strip()
        items = _flow(inner) if inner else []
        return [_scalar(i) for i in items] if text[0] == "[" else {str(_scalar(i.split(":", 1)[0])): _scalar(i.split(":", 1)[1]) for i in items}
    plain = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in plain:
        return plain[text.lower()]
    for number in (int, float):
        try:
            return number(text.replace("_", ""))
        except ValueError:
            continue
    return text


def _flow(text: str) -> list[str]:
    """Items of a list in brackets, cut at commas outside quotes and brackets."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def read_yaml(text: str):
    """Nested maps, lists, flow lists and scalars of YAML; anchors, tags, several documents and multi-line scalars raise."""
    rows = []
    for line in text.split("\n"):
        quote, end = "", len(line)
        for i, c in enumerate(line):
            if quote:
                # A doubled quote inside quotes opens them again at once.
                quote = "" if c == quote else quote
            elif c in "'\"" and (line[:i].rstrip()[-1:] in (":", "-", ",", "[", "{", "") or line[i - 1] == c):
                quote = c
            elif c == "#" and (i == 0 or line[i - 1] in " \t"):
                end = i
                break
        line = line[:end].rstrip()
        if line.strip():
            body = line.strip()
            if body[:1] in "&*!%" or body in ("---", "...") and rows or body.endswith((": |", ": >", "- |", "- >")):
                raise ValueError(f"YAML beyond nested maps, lists and scalars: {body}")
            if body not in ("---", "..."):
                rows.append((len(line) - len(line.lstrip()), body))
    value, at = _yaml_block(rows, 0, rows[0][0]) if rows else (None, 0)
    if at < len(rows):
        raise ValueError(f"bad indentation: {rows[at][1]}")
    return value


def _yaml_block(rows: list[tuple[int, str]], at: int, indent: int):
    listed = rows[at][1].startswith("- ") or rows[at][1] == "-"
    out = [] if listed else {}
    while at < len(rows) and rows[at][0] == indent and (rows[at][1].startswith("- ") or rows[at][1] == "-") == listed:
        body = rows[at][1]
        if listed:
            rest = body[1:].strip()
            head = rest.split(":", 1)
            if rest and rest[0] not in "'\"[{" and (rest.endswith(":") or ": " in rest) and len(head) == 2:
                # A map that begins on the item's own line: its keys stand where the first one does.
                inner = indent + len(body) - len(rest)
                rows[at] = (inner, rest)
                value, at = _yaml_block(rows, at, inner)
                out.append(value)
                continue
            key = None
        else:
            quoted = re.match(r"""('(?:[^']|'')*'|"(?:[^"\\]|\\.)*")(:)""", body)
            key, sep, rest = (quoted[1], ":", body[quoted.end() :]) if quoted else body.partition(":")
            if not sep or rest and not rest.startswith(" "):
                raise ValueError(f"no key: {body}")
            rest = rest.strip()
        at += 1
        if rest:
            value = _scalar(rest)
        elif at < len(rows) and (rows[at][0] > indent or not listed and rows[at][0] == indent and rows[at][1].startswith("-")):
            value, at = _yaml_block(rows, at, rows[at][0])
        else:
            value = None
        if listed:
            out.append(value)
        else:
            out[str(_scalar(key))] = value
    return out, at
