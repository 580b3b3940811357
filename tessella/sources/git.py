"""Version history as a Spark data source: one row per (commit, parent, changed file) with both contents.

``spark.read.format("githistory").option("repo", path).load()``; each partition is a batch of commits
that a task reads with its own git processes. The repository must be on a file system that the executors share.
"""

from __future__ import annotations

import re
import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import RAW_CHANGE


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout


class Objects:
    """Blobs of a repository through one ``cat-file --batch`` process."""

    def __init__(self, repo: str):
        self.process = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def text(self, name: str) -> str | None:
        """Content of an object; None if there is none or it is no blob."""
        if "\n" in name:
            return None
        self.process.stdin.write(name.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) < 3 or not head[2].isdigit():
            return None
        data = self.process.stdout.read(int(head[2]) + 1)[:-1]
        return data.decode("utf-8", "replace") if head[1] == b"blob" else None

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()


def _stream(repo: str, lines: list[str], *args: str) -> Iterator[bytes]:
    """Lines of the output of one git process that reads ``lines``."""
    with tempfile.TemporaryFile() as given:
        given.write("".join(f"{l}\n" for l in lines).encode())
        given.seek(0)
        process = subprocess.Popen(["git", "-C", repo, *args], stdin=given, stdout=subprocess.PIPE)
        yield from process.stdout
        if process.wait():
            raise subprocess.CalledProcessError(process.returncode, args)


def _by_pair(stream: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Output lines of each pair of commits; a line that is a commit id begins the next."""
    part: list[bytes] | None = None
    for line in stream:
        if len(line) in (41, 65) and not line.startswith((b" ", b"+", b"-", b":", b"@", b"\\")) and all(c in b"0123456789abcdef" for c in line[:-1]):
            if part is not None:
                yield part
            part = []
        else:
            part.append(line)
    if part is not None:
        yield part


def _unquoted(path: bytes) -> str:
    """A path as raw lines give it, with its quotes and escapes undone."""
    if path.startswith(b'"'):
        path = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"v": b"\v"}.get(m[1], m[1]), path[1:-1])
    return path.decode("utf-8", "replace")


def _hunks(patch: list[bytes]) -> list[str]:
    """The hunks of each file of a patch, without the lines before the first one."""
    files: list[list[bytes]] = []
    for line in patch:
        if line.startswith(b"diff --git "):
            files.append([])
        elif files and (files[-1] or line.startswith(b"@@")):
            files[-1].append(line)
    return [b"".join(f).decode("utf-8", "replace") for f in files]


def batch_rows(repo: str, commits: list[str]) -> Iterator[tuple]:
    """Rows of a batch of commits from four git processes, whatever the number of files: logs, changes, patches and blobs."""
    if not commits:
        return
    text = b"".join(_stream(repo, commits, "log", "--no-walk=unsorted", "--stdin", "--format=%H%x00%an <%ae>%x00%cI%x00%P%x00%B%x00")).decode("utf-8", "replace")
    fields = text.split("\0")
    logs = [(h.strip(), author, date, parents.split(), message.rstrip("\n")) for h, author, date, parents, message in zip(*(fields[k::5] for k in range(5)), strict=False) if h.strip()]
    pairs = [f"{h} {p}" for h, _, _, parents, _ in logs for p in parents]
    tree = ("diff-tree", "--stdin", "--always", "-r", "-M", "-C", "--no-abbrev")
    changes, patches = _by_pair(_stream(repo, pairs, *tree, "--raw")), _by_pair(_stream(repo, pairs, *tree, "-p"))
    blobs = Objects(repo)
    try:
        for commit, author, date, parents, message in logs:
            toolchain = blobs.text(f"{commit}:lean-toolchain")
            for parent in parents:
                rows, hunks = [l.rstrip(b"\n") for l in next(changes)], _hunks(next(patches))
                if len(rows) != len(hunks):
                    hunks = [None] * len(rows)
                for row, diff in zip(rows, hunks, strict=True):
                    head, *paths = row.split(b"\t")
                    _, _, old, new, status = head.decode().split(" ")
                    names = [_unquoted(p) for p in paths]
                    before, after = (None if status[0] == "A" else names[0]), (None if status[0] == "D" else names[-1])
                    if diff is None:  # a change of kind is two files in the patch
                        whole = git(repo, "diff", "-M", "-C", parent, commit, "--", *dict.fromkeys(names)).decode("utf-8", "replace")
                        diff = whole[whole.find("@@") :] if "@@" in whole else ""
                    yield commit, author, message, date, parents, toolchain, parent, before, after, before and blobs.text(old), after and blobs.text(new), diff, status[0] == "C"
    finally:
        blobs.close()


class Batch(InputPartition):
    def __init__(self, start: str, skip: int):
        self.start, self.skip = start, skip


class GitReader(DataSourceReader):
    """The driver learns how many commits there are; each task lists its own."""

    def __init__(self, options: dict):
        self.repo, self.batch, self.ref = options["repo"], int(options.get("batch", 200)), options.get("ref", "HEAD")

    def partitions(self) -> list[Batch]:
        start = git(self.repo, "rev-parse", self.ref).decode().strip()
        total = int(git(self.repo, "rev-list", "--count", start))
        return [Batch(start, i) for i in range(0, total, self.batch)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        commits = git(self.repo, "rev-list", f"--skip={partition.skip}", f"--max-count={self.batch}", partition.start).decode().split()
        yield from batch_rows(self.repo, commits)


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "githistory"

    def schema(self) -> str:
        return RAW_CHANGE

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(GitHistory)
