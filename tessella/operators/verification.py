"""Per-commit builds and checks with external programs; what to run is given as hooks, so that stubs can stand in.

Worktrees live in a temporary folder of the task that makes them and go when it ends; nothing in them is read by
another task. A task that is lost starts its commit again from the snapshot and the store.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
import signal
import subprocess
import tempfile
import traceback
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .runner import with_retries
from .store import TOLERATED_FAILURES

RESULT = f"commit_hash string, code string, status string, verification_result {schemas.VERIFICATION}"
BUILT = "commit_id string, rel_path string, hash string, type string, content binary, status string, message string"


def stop(process: subprocess.Popen) -> None:
    """End a process with all it started, if it is of a group of its own."""
    with contextlib.suppress(ProcessLookupError):
        os.killpg(process.pid, signal.SIGKILL)
    process.wait()


def run(command: list[str], folder: str, timeout: float) -> tuple[int, str, str]:
    """Exit code, output and errors of a command; past the timeout it and its children are ended and TimeoutExpired is raised."""
    process = subprocess.Popen(command, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace", start_new_session=True)
    try:
        out, err = process.communicate(timeout=timeout)
    except BaseException:
        stop(process)
        raise
    return process.returncode, out, err


def messages(output: str) -> list[dict]:
    """Type and text of each line of compiler output, as text.compiler_lines classifies them."""
    kind = lambda l: "error" if "error" in l else "warning" if "warning" in l else "info"
    return [{"type": kind(l.lower()), "message": l.strip()} for l in output.split("\n") if l.strip()]


def check(code: str, folder: str, command: list[str], timeout: float = 600, suffix: str = ".lean") -> dict:
    """Verdict on a source text: the command is run on a temporary file of it."""
    names = ("parsed_output", "raw_output", "raw_stderr", "returncode", "pass", "complete", "lean_output", "system_error")
    with tempfile.NamedTemporaryFile("w", suffix=suffix, encoding="utf-8") as file:
        file.write(code)
        file.flush()
        try:
            returned, out, err = run([*command, file.name], folder, timeout)
        except Exception:
            return dict.fromkeys(names) | {"pass": False, "complete": False, "system_error": traceback.format_exc()}
    parsed = messages(out)
    passed = returned == 0 and not any(m["type"] == "error" for m in parsed)
    return dict.fromkeys(names) | {"parsed_output": parsed, "raw_output": out, "raw_stderr": err, "returncode": returned, "pass": passed, "complete": passed and not any(m["type"] == "warning" for m in parsed)}


@dataclass
class Hooks:
    """What verification and builds call: a blob of the store by its hash, the build of a worktree (None if it is fine), and the check of one text."""

    blob: Callable[[str], bytes]
    build: Callable[[str], str | None]
    check: Callable[[str, str], dict]
    threads: int = 4


def restore(entries: list[tuple[str, str, str]], blob: Callable[[str], bytes], folder: str) -> int:
    """Write (rel_path, hash, type) entries into a folder; the number that failed."""
    failed = 0
    for path, digest, kind in entries:
        target = os.path.join(folder, path)
        try:
            if os.path.commonpath([os.path.realpath(folder), os.path.realpath(os.path.dirname(target))]) != os.path.realpath(folder):
                raise ValueError(f"{path} leaves the worktree")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            content = blob(digest)
            if kind == "symlink":
                os.symlink(content.decode(), target)
            else:
                with open(target, "wb") as file:
                    file.write(content)
        except Exception:  # noqa: BLE001 - a failed file is counted
            failed += 1
    return failed


def verify_commit(entries: list[tuple[str, str, str]], codes: list[str], hooks: Hooks, tolerated: int = TOLERATED_FAILURES) -> tuple[str, list[dict | None]]:
    """Status (ready, restore_failed or failed_verify) and the verdict on each text; none where the worktree cannot be used."""
    folder = tempfile.mkdtemp(prefix="worktree-")
    try:
        if restore(entries, hooks.blob, folder) > tolerated:
            return "restore_failed", [None] * len(codes)
        if hooks.build(folder) is not None:
            return "failed_verify", [None] * len(codes)
        with ThreadPoolExecutor(max(1, hooks.threads)) as pool:
            return "ready", list(pool.map(lambda code: hooks.check(code, folder), codes))
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def verify(records: DataFrame, snapshots: DataFrame, hooks: Hooks, per_slice: int = 200) -> DataFrame:
    """records (commit_hash, code), snapshots (commit_id, rel_path, hash, type) -> RESULT, one row for each record with code.

    A commit's records are cut into slices of about ``per_slice``, each with a worktree of its own, so one commit with
    very many records is spread over tasks; a task holds paths and hashes of a worktree, not contents.
    """
    valid = records.select("commit_hash", "code").where(F.coalesce("code", F.lit("")) != "")
    sizes = valid.groupBy("commit_hash").agg(F.ceil(F.count(F.lit(1)) / per_slice).cast("int").alias("slices"))
    cut = valid.join(sizes, "commit_hash").withColumn("slice", F.pmod(F.xxhash64("code"), F.col("slices")).cast("int"))
    cut = cut.toDF(*cut.columns)
    slices = cut.select("commit_hash", "slice").distinct()
    files = snapshots.withColumnRenamed("commit_id", "commit_hash").join(slices, "commit_hash").select("commit_hash", "slice", "rel_path", "hash", "type")
    # New names for the columns: both sides come from the same records.
    files = files.select(*[F.col(c).alias(f"{c}_") for c in files.columns]).toDF(*files.columns)

    def run_slice(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["commit_hash", "code", "status", "verification_result"])
        codes = left["code"].tolist()
        status, verdicts = verify_commit(list(right[["rel_path", "hash", "type"]].itertuples(index=False, name=None)), codes, hooks)
        return pd.DataFrame({"commit_hash": left["commit_hash"].tolist(), "code": codes, "status": status, "verification_result": pd.Series(verdicts, dtype=object)})

    return cut.groupBy("commit_hash", "slice").cogroup(files.groupBy("commit_hash", "slice")).applyInPandas(run_slice, RESULT)


def tree(folder: str) -> Iterator[tuple[str, str, str, bytes]]:
    """(rel_path, hash, type, content) of every file and link below a folder; a link's content is its target."""
    for top, folders, names in os.walk(folder):
        for name in sorted(names + [f for f in folders if os.path.islink(os.path.join(top, f))]):
            path = os.path.join(top, name)
            link = os.path.islink(path)
            content = os.readlink(path).encode() if link else open(path, "rb").read()
            yield os.path.relpath(path, folder), hashlib.sha256(content).hexdigest(), "symlink" if link else "regular", content


def build(commits: DataFrame, checkout: Callable[[str, str], None], cache: Callable[[str], None], compile_: Callable[[str], str | None], retries: int = 10, wait: float = 30.0) -> DataFrame:
    """commits (commit_id) -> BUILT: the files of each built worktree, or one row without a path where it failed.

    checkout(commit, folder) fills a folder, cache(folder) fetches prebuilt parts and is tried again, compile_(folder)
    gives None or what went wrong. ``store.absent`` keeps the new contents, ``store.snapshot`` the trees.
    """

    def one(commit: str) -> Iterator[tuple]:
        folder = tempfile.mkdtemp(prefix="build-")
        try:
            checkout(commit, folder)
            with_retries(cache, retries, wait, wait, 0.2 * wait)(folder)
            if (said := compile_(folder)) is not None:
                yield commit, None, None, None, None, "failed", said
                return
            for path, digest, kind, content in tree(folder):
                yield commit, path, digest, kind, content, "collapsed", None
        except Exception:
            yield commit, None, None, None, None, "failed", traceback.format_exc()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    names = [f.strip().split(" ")[0] for f in BUILT.split(",")]

    def run_all(frames):
        for frame in frames:
            for commit in frame["commit_id"]:
                rows, size = [], 0
                for row in one(commit):
                    rows.append(row)
                    size += len(row[4] or b"")
                    if size > 32 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    return commits.select("commit_id").mapInPandas(run_all, BUILT)


def install(toolchains: DataFrame, hook: Callable[[str], None], tasks: int = 8) -> DataFrame:
    """toolchains (toolchain) -> toolchain, installed, message: the hook runs once for each distinct one."""

    def run_all(frames):
        for frame in frames:
            out = []
            for name in frame["toolchain"]:
                try:
                    hook(name)
                    out.append((name, True, None))
                except Exception as e:  # noqa: BLE001 - one toolchain does not stop the others
                    out.append((name, False, str(e)))
            yield pd.DataFrame(out, columns=["toolchain", "installed", "message"])

    return toolchains.select("toolchain").distinct().repartition(tasks).mapInPandas(run_all, "toolchain string, installed boolean, message string")
