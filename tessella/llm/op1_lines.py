"""Line dedup with a log-template tree.

Every line with a word goes to a leaf of a tree of fixed depth: its word count,
then its first DEPTH words. Words with a digit or @ are variable fields and
become wildcards at once, but not in lines of fewer than DEPTH words, nor in those
of fewer than 2 * DEPTH words that have no other word: these are compared whole. Within a leaf, templates are taken in
order of their counts (then of their hash) and join the first group whose
constant words agree in SIMILARITY or more of all positions; positions that
differ become wildcards. Where SIMILARITY allows c changed words, the words after
the first DEPTH are cut into c + 1 pieces: a group that can take a template shares
a whole piece with it, so looking groups up by their pieces misses none.

A group that occurs in MIN_DOCS or more documents, or in LONG_DOCS or more if its
lines have LONG_TOKENS or more words, is a recurring template: all its lines are
dropped but the first line of the document with the smallest id.

Lines travel as hashes (16 bits a word, for the comparison of templates); the
text itself is shuffled once, when the lines are taken out. Leaves are counted
first with map-side sums, and only lines of leaves that recur go on. Within a
leaf equal templates are one row, so a line that a third of all documents hold
is one row there.

Defined cases: null text stays null and empty text stays empty; documents that
lose all their words are dropped, those that had none before are kept; repeated
rows count as one document and get equal results; lines of any length are
handled; no documents give no rows; all columns of documents pass through, and
n_chars, if there, is set to the new length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _TABLES, PowerTable, materialise, mix64, row_key, table, text_buffers, word_hashes, word_spans

DEPTH, MIN_TOKENS, SIMILARITY, MIN_DOCS = 3, 1, 0.75, 5
LONG_TOKENS, LONG_DOCS = 50, 2
_U = np.uint64
_WILD = _U(0x5BD1E9955BD1E995)
_VARIABLE = np.zeros(256, bool)
_VARIABLE[[*range(48, 58), 64]] = True
_WORD_BASE = 0xD6E8FEB86659FD93


def line_templates(buf: np.ndarray, offs: np.ndarray):
    """Of each line of MIN_TOKENS or more words: row, line number, leaf, template hash, and the words' 16-bit prints with their offsets."""
    starts, ends, rows = word_spans(buf, offs)
    hashes, _ = word_hashes(buf, offs)
    variable = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_VARIABLE[buf], out=variable[1:])
    breaks = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(buf == 10, out=breaks[1:])
    line = breaks[starts] - breaks[offs[rows]]
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(starts)])
    field = variable[ends] > variable[starts]
    fields = np.r_[0, np.cumsum(field)]
    whole = (count < DEPTH) | (count < 2 * DEPTH) & (fields[first + count] - fields[first] == count)
    size = np.repeat(count, count)
    hashes = np.where(field & ~np.repeat(whole, count), _WILD, hashes)
    keep = count >= MIN_TOKENS
    first, count = first[keep], count[keep]
    leaf = mix64(count.astype(_U))
    for d in range(DEPTH):
        has = count > d
        leaf[has] = mix64(leaf[has] * _U(31) + hashes[first[has] + d])
    powers = _TABLES.setdefault(_WORD_BASE, PowerTable(_WORD_BASE))
    powers.need(len(hashes) + 1)
    run = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * powers.up[: len(hashes)], out=run[1:])
    template = mix64((run[first + count] - run[first]) * powers.down[first])
    prints = (hashes >> _U(48)).astype(np.uint16)
    prints[hashes == _WILD] = 0
    return rows[first], line[first], leaf, template, prints[size >= MIN_TOKENS], np.r_[0, np.cumsum(count)]


def _lines(docs: DataFrame, tokens: bool) -> DataFrame:
    """docs (k1, k2, text) -> leaf, long (of LONG_TOKENS or more words) and, with tokens, template, k1, k2, line, words."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in text_buffers(batch.column(2)):
                rows, line, leaf, template, prints, at = line_templates(buf, offs)
                columns = [pa.array(leaf.view(np.int64)), pa.array(np.diff(at) >= LONG_TOKENS)]
                if tokens:
                    words = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((at * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(prints))])
                    take = pa.array(rows + lo)
                    columns += [pa.array(template.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(line.astype(np.int32)), words]
                yield pa.RecordBatch.from_arrays(columns, names=["leaf", "long", "template", "k1", "k2", "line", "words"][: len(columns)])

    return docs.mapInArrow(run, "leaf long, long boolean, template long, k1 long, k2 long, line int, words binary" if tokens else "leaf long, long boolean")


class Leaf:
    """Template groups of one leaf: all templates have one length and the same first DEPTH words."""

    def __init__(self):
        self.constant = self.fixed = np.zeros((0, 0))
        self.name: list[int] = []
        self.pieces: dict[tuple[int, bytes], list[int]] = {}

    def add(self, template: int, words: np.ndarray) -> int:
        """Name of the group that takes this template: that of its first member."""
        n, made = len(words), len(self.name)
        changes = next(c for c in range(int(n * (1 - SIMILARITY)) + 1, -1, -1) if (n - c) / n >= SIMILARITY)
        head = min(DEPTH, n)
        cuts = [head + (n - head) * q // (changes + 1) for q in range(changes + 2)]
        keys = [(q, words[a:b].tobytes()) for q, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        near = sorted({g for k in keys for g in self.pieces.get(k, ())})
        if near:
            share = (self.constant[near] == words) & self.fixed[near]
            share = share.sum(axis=1) / n
            best = int(share.argmax())
            if share[best] >= SIMILARITY:
                self.fixed[near[best]] &= self.constant[near[best]] == words
                return self.name[near[best]]
        if made == len(self.constant):
            constant, fixed = np.zeros((2 * made + 1, n), np.uint16), np.ones((2 * made + 1, n), bool)
            if made:
                constant[:made], fixed[:made] = self.constant, self.fixed
            self.constant, self.fixed = constant, fixed
        self.constant[made] = words
        self.name.append(template)
        for k in keys:
            self.pieces.setdefault(k, []).append(made)
        return template


def _grow(batches):
    """(leaf, template, n, words), sorted by leaf, n descending and template -> leaf, template, grp."""
    current, leaf = None, None
    for batch in batches:
        names = []
        for lf, template, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if lf != current:
                current, leaf = lf, Leaf()
            names.append(leaf.add(template, np.frombuffer(words, np.uint16)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64())], names=["leaf", "template", "grp"])


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id, text) -> k1, k2, drop (line numbers), n_templates for documents that lose lines."""
    source = docs.select(*row_key(), "text")
    enough = F.when(F.col("long"), min(min_docs, LONG_DOCS)).otherwise(min_docs)
    leaves = _lines(source, False).groupBy("leaf", "long").count().where(F.col("count") >= enough).select("leaf")
    # Written out, as the groups below, so that a leaf with very many lines is a skewed side of a plain join, which adaptive
    # execution splits. The joins are merges at every size: these tables grow with the documents.
    leaves = materialise(leaves.distinct(), "leaves").hint("merge")
    lines = materialise(_lines(source, True).join(leaves, "leaf", "left_semi"), "lines")
    templates = lines.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words"))
    groups = templates.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "template").mapInArrow(_grow, "leaf long, template long, grp long")
    groups = materialise(groups, "template-groups").hint("merge")
    placed = lines.select("leaf", "long", "template", "k1", "k2", "line").join(groups, ["leaf", "template"])
    per_doc = placed.groupBy("leaf", "long", "grp", "k1", "k2").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    per_doc = materialise(per_doc, "line-groups")
    often = per_doc.groupBy("leaf", "long", "grp").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("k1", "k2")).alias("owner")).where(F.col("n_docs") >= enough).drop("long")
    own = (F.col("owner.k1") == F.col("k1")) & (F.col("owner.k2") == F.col("k2"))
    often = materialise(often, "recurring").hint("merge")
    hit = per_doc.join(often, ["leaf", "grp"]).select("k1", "k2", F.when(own, F.slice("lines", F.lit(2), F.size("lines"))).otherwise(F.col("lines")).alias("lines"))
    return hit.where(F.size("lines") > 0).groupBy("k1", "k2").agg(F.flatten(F.collect_list("lines")).alias("drop"), F.count(F.lit(1)).alias("n_templates"))


_DROP, _COUNT = "dropped_lines", "recurring_templates"


def mark(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with new text and the columns dropped_lines (count) and recurring_templates; all rows stay."""
    key = [c.alias(f"__{n}") for c, n in zip(row_key(), ("k1", "k2"), strict=True)]
    gone = recurring(docs, min_docs).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("drop").alias("__drop"), F.col("n_templates").alias("__n"))
    joined = docs.drop(_DROP, _COUNT).select("*", *key).join(gone, ["__k1", "__k2"], "left")
    parts = F.split("text", "\n", -1)
    state = F.struct(parts.alias("p"), F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__drop").alias("keep"))
    # A one-element array makes the split text a variable, so it is split once.
    rest = F.transform(F.array(state), lambda s: F.array_join(F.transform(s["keep"], lambda i: F.get(s["p"], i)), "\n"))[0]
    out = joined.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__drop").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    counts = (F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias(_DROP), F.coalesce("__n", F.lit(0)).cast("long").alias(_COUNT))
    kept = [c for c in docs.columns if c not in (_DROP, _COUNT)]
    return out.select(*kept, F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(counts[0]).alias(_DROP), counts[1])


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without recurring lines and without documents that have no word left; columns as they were."""
    out = mark(docs, min_docs)
    return out.where((F.col(_DROP) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[c for c in docs.columns])


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(_DROP).alias("n_dropped"), F.col(_COUNT).alias("n_templates"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_kept_chars"))
