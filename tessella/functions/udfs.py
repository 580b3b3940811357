"""Arrow functions over the sequential text algorithms, and a registry for callables of users.

Each is marked as not deterministic so that the optimizer evaluates it once even where a filter and
a projection both use its result.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import ArrowUDFType, arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from . import repair as R
from . import source_text as S


def _text(v):
    return v if isinstance(v, str) else None


#: Rows of a batch that a worker holds as Python values at a time, beside the batch that Spark sent (at most 64 MB by its default).
SLICE = 100


class Once:
    """A row function as an Arrow function that runs once a row, slice by slice of a batch; it is built at its first use."""

    def __init__(self, function: Callable, returns: str):
        self.function, self.returns, self.built = function, returns, None

    def build(self):
        if self.built is None:
            function, kind = self.function, DataType.fromDDL(self.returns)
            # A row without a result is a struct of nulls.
            empty, returned = dict.fromkeys(kind.names) if isinstance(kind, StructType) else None, to_arrow_type(kind)

            def slices(batches):
                for batch in batches:
                    columns = batch if isinstance(batch, tuple) else (batch,)
                    for at in range(0, len(columns[0]), SLICE):
                        rows = zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)
                        done = (function(*map(_text, row)) for row in rows)
                        yield pa.array([empty if r is None else r for r in done], returned)

            self.built = arrow_udf(slices, self.returns, ArrowUDFType.SCALAR_ITER).asNondeterministic()
        return self.built

    def __call__(self, *columns) -> Column:
        return self.build()(*columns)


def once(function: Callable, returns: str) -> Once:
    return Once(function, returns)


strip_comments = once(lambda t: None if t is None else S.strip_comments(t), "string")
code_only = once(lambda t: None if t is None else S.code_only(t), "string")
unified_diff = once(lambda a, b: S.unified_diff(a or "", b or ""), "string")
apply_diff = once(lambda t, d: S.apply_diff(t or "", d or ""), "string")
good_edit = once(lambda a, b: S.good_edit(a, b), "boolean")
filtered_diff = once(
    lambda a, b: dict(zip(("diff", "added", "total", "pure", "net"), S.filtered_diff(a, b), strict=True)), "struct<diff:string,added:int,total:int,pure:int,net:int>"
)
edit_runs = once(lambda a, b: dict(zip(("scattered", "blocks", "total"), S.edit_runs(a or "", b or ""), strict=True)), "struct<scattered:int,blocks:int,total:int>")
pair_stats = once(lambda a, b: S.pair_stats(a, b), f"struct<{','.join(f'{n}:double' for n in S.PAIR_FIELDS)}>")


def _safe_pair_stats(before: str | None, after: str | None) -> dict | None:
    try:
        return S.pair_stats(before, after)
    except Exception:  # noqa: BLE001 - a file that cannot be read has no statistics
        return None


safe_pair_stats = once(lambda a, b: _safe_pair_stats(a, b), f"struct<{','.join(f'{n}:double' for n in S.PAIR_FIELDS)}>")
added_deleted = once(lambda a, b: dict(zip(("added", "deleted"), S.added_deleted(a or "", b or ""), strict=True)), "struct<added:int,deleted:int>")
definitions = once(lambda t: S.definitions(t or ""), "array<struct<kind:string,keyword:string,name:string,start:int,end:int,content:string>>")
exercises = once(
    lambda t: S.exercises(t), "array<struct<num:int,title:string,hunk_span:string,task_category:string,focus:string,difficulty:string,task_nature:string,instruction:string>>"
)
repair_diff = once(lambda t, d: dict(zip(("patch", "content"), R.repair(t or "", d or ""), strict=True)), "struct<patch:string,content:string>")


def _timed_repair(text: str | None, diff: str | None) -> dict:
    """Repair with its seconds and, where it fails, why; a diff that is repaired but does not apply has failed."""
    start, patch, content, error = time.perf_counter(), None, None, None
    if diff is None:
        error = "no diff"
    else:
        try:
            patch, content = R.repair(text or "", diff)
            if patch is not None:
                content = S.apply_diff(text or "", patch)
            if content is None:
                patch, error = None, "no hunk finds its place" if patch is None else "the repaired diff does not apply"
        except Exception as e:  # noqa: BLE001 - a failure is a result
            patch, error = None, f"{type(e).__name__}: {e}"
    return {"patch": None if content is None else S.unified_diff(text or "", content), "content": content, "error": error, "seconds": time.perf_counter() - start}


timed_repair = once(lambda t, d: _timed_repair(t, d), "struct<patch:string,content:string,error:string,seconds:double>")
_RESPONSE = (
    "gen_patch", "gen_content_from_scratch", "gen_patch_after_exact_repair", "gen_content_after_exact_repair", "gen_patch_after_robust_repair",
    "gen_content_after_robust_repair", "best_gen_content", "best_gen_patch", "best_gen_patch_comment_free",
)
patch_response = once(lambda t, a: R.response(t, a), f"struct<{','.join(f'{n}:string' for n in _RESPONSE)}>")

_LEX = "array<struct<kind:string,value:string,offset:int,line:int,column:int>>"
lex = once(lambda t: [dict(zip(("kind", "value", "offset", "line", "column"), x, strict=True)) for x in S.tokens(t or "")], _LEX)


def token_counter(encode: Callable[[str], list] | None = None):
    """Token count as a column function: of the given encoder, or the built-in offline rule."""
    if encode is None:
        from .text import token_count

        return token_count
    return once(lambda t: len(encode(t)) if t else 0, "int")


#: Fixed value: how byte-level BPE of the public 50k vocabulary cuts a text before merging.
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankEncoder:
    """Byte-pair encoder from a file of ranks (base64 token and rank a line), built once in each worker."""

    def __init__(self, path: str, pattern: str = BPE_PATTERN):
        self.path, self.pattern, self.made = path, pattern, None

    def __call__(self, text: str) -> list[int]:
        if self.made is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.made = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self.made.encode_ordinary(text)

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "made": None}


REGISTRY: dict[str, Once] = {
    "strip_comments": strip_comments, "code_only": code_only, "unified_diff": unified_diff, "apply_diff": apply_diff, "good_edit": good_edit, "filtered_diff": filtered_diff,
    "edit_runs": edit_runs, "pair_stats": pair_stats, "definitions": definitions, "exercises": exercises, "repair_diff": repair_diff, "patch_response": patch_response,
}


def register_all(spark: SparkSession) -> None:
    """Make the functions callable from SQL under their names."""
    for name, function in REGISTRY.items():
        spark.udf.register(name, function.build())
