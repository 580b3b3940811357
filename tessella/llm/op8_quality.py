"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line gets features of its own and of its two neighbours. A two-state chain
(bad, good) is trained with the document's label on all its lines; forward-
backward marginals of the good state, weighted by line length, are averaged
into the document's quality, which a logistic map fitted on the same rows turns
into a score.

Training uses at most ``TRAIN_DOCS`` labelled documents (those with the
smallest hash of their id), all lines of each, and runs on the executors by
iterative parameter mixing: the documents are dealt by hash to shards of about
``SHARD_DOCS``, each shard goes on from the common parameters for some epochs over
batches of whole chains, and the driver averages what the shards return, ``ROUNDS``
times. The driver sees parameters, sums of features and one figure a document for
the logistic map, never texts or lines. Scoring reads every line of every
document, in batches, without a shuffle. No label, language, source or id enters
a score.

Defined cases: null text is empty; a text without lines of content is one empty
line and gets the score that the chain gives to that; lines of any length are
one step; without training rows of both labels every score is the share of
good labels (0.5 without labels); repeated rows get equal rows, and of several
texts of a labelled id the one with the smallest hash is learned; no documents
give no rows; of documents only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _IS_SPACE, materialise, table, text_buffers, word_hashes, word_spans

TRAIN_DOCS, THRESHOLD, FOLDS = 6000, 0.3, 5
SHARD_DOCS, BATCH_DOCS, ROUNDS, EPOCHS, RATE, L2 = 500, 64, 3, 5, 0.05, 1e-3
_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 stop, 5 other ASCII sign, 6 beyond ASCII, 0 space and control
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
for _c in range(33, 127):
    if _CLASS[_c] == 0:
        _CLASS[_c] = 5
_CLASS[128:] = 6
OWN = 16


def line_spans(buf: np.ndarray, offs: np.ndarray):
    """Start, end and row of each line that has a word; a row without any gives one empty line."""
    n = len(buf)
    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    starts = starts[starts < n]
    ends = np.minimum(np.append(starts[1:], n), n)
    inside = np.zeros(n + 1, np.int64)
    np.cumsum(~_IS_SPACE[buf], out=inside[1:])
    full = inside[ends] > inside[starts]
    starts, ends = starts[full], ends[full]
    rows = np.searchsorted(offs, starts, "right") - 1
    bare = np.setdiff1d(np.arange(len(offs) - 1), rows)
    starts, ends, rows = np.r_[starts, offs[bare]], np.r_[ends, offs[bare]], np.r_[rows, bare]
    order = np.lexsort((starts, rows))
    return starts[order], ends[order], rows[order]


def features(buf: np.ndarray, offs: np.ndarray):
    """Own features of every line (lines x OWN), lengths in bytes and rows."""
    starts, ends, rows = line_spans(buf, offs)
    size = (ends - starts).astype(np.float64)
    kinds = _CLASS[buf]
    x = np.zeros((len(starts), OWN), np.float32)
    total = np.maximum(size, 1.0)
    for k in range(1, 7):
        run = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(kinds == k, out=run[1:])
        x[:, k - 1] = (run[ends] - run[starts]) / total
    ws, we, _ = word_spans(buf, offs)
    hashes, _ = word_hashes(buf, offs)
    line = np.searchsorted(starts, ws, "right") - 1
    count = np.bincount(line, minlength=len(starts)).astype(np.float64)
    some = np.maximum(count, 1.0)
    length = (we - ws).astype(np.float64)
    mean = np.bincount(line, length, len(starts)) / some
    x[:, 6] = np.minimum(mean / 10.0, 3.0)
    x[:, 7] = np.sqrt(np.maximum(np.bincount(line, length * length, len(starts)) / some - mean * mean, 0.0)) / 5.0
    x[:, 8] = np.log1p(count) / 4.0
    # Share of distinct words, of words equal to the one before, and of distinct pairs of words.
    key = hashes ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
    x[:, 9] = np.bincount(line, fresh, len(starts)) / some
    same = np.zeros(len(key))
    pair = np.zeros(len(key), np.uint64)
    if len(key) > 1:
        joined = line[1:] == line[:-1]
        same[1:] = (hashes[1:] == hashes[:-1]) & joined
        pair[1:] = np.where(joined, hashes[1:] * np.uint64(3) + hashes[:-1], 0) ^ (line[1:].astype(np.uint64) << np.uint64(40))
    x[:, 10] = np.bincount(line, same, len(starts)) / some
    order = np.argsort(pair, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[order[1:]] = pair[order[1:]] != pair[order[:-1]]
    x[:, 11] = np.bincount(line, fresh, len(starts)) / some
    last = we - 1
    odd = (kinds[last] == 5) if len(last) else np.zeros(0, bool)
    x[:, 12] = np.bincount(line, odd, len(starts)) / some
    big = (kinds[ws] == 2) if len(ws) else np.zeros(0, bool)
    x[:, 13] = np.bincount(line, big, len(starts)) / some
    x[:, 14] = np.bincount(line, length == 1, len(starts)) / some
    # The same line elsewhere in the document, by the sum of its word hashes.
    mixed = np.zeros(len(starts), np.uint64)
    np.add.at(mixed, line, hashes)
    whole = mixed ^ (rows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, at, often = np.unique(whole, return_inverse=True, return_counts=True)
    x[:, 15] = np.where(count > 0, np.minimum(often[at] - 1, 5) / 5.0, 0.0)
    return x, size, rows


def with_neighbours(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zero at the ends), the two ends and a constant."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    first, last = np.ones(n, np.float32), np.ones(n, np.float32)
    if n > 1:
        joined = rows[1:] == rows[:-1]
        before[1:][joined], after[:-1][joined] = x[:-1][joined], x[1:][joined]
        first[1:][joined] = 0
        last[:-1][joined] = 0
    return np.concatenate([x, x * x, before, after, first[:, None], last[:, None], np.ones((n, 1), np.float32)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # emission of good over bad
    move: np.ndarray  # 2 x 2 transition scores
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def _padded(rows: np.ndarray):
    """Documents by descending length: start of each, length, and for each step the number of documents that reach it."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(rows)])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    reach = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right") if len(size) else np.zeros(0, np.int64)
    return first, size, reach


def chain(emission: np.ndarray, move: np.ndarray, rows: np.ndarray, labels: np.ndarray | None = None):
    """Marginals of the good state; with labels also the log-likelihood and the expected minus the seen transitions.

    Documents are advanced together, one line of each at a step, in the space of scaled probabilities.
    """
    first, size, reach = _padded(rows)
    n = len(rows)
    e = np.empty((n, 2))
    top = np.maximum(emission, 0.0)
    e[:, 0], e[:, 1] = np.exp(-top), np.exp(emission - top)
    a = np.exp(move - move.max())
    alpha, beta, norm = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    for t, m in enumerate(reach):
        at = first[:m] + t
        v = e[at] if t == 0 else (alpha[at - 1] @ a) * e[at]
        c = v.sum(1)
        alpha[at], norm[at] = v / c[:, None], c
    for t in range(len(reach) - 2, -1, -1):
        at = first[: reach[t + 1]] + t
        beta[at] = (e[at + 1] * beta[at + 1]) @ a.T / norm[at + 1][:, None]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    if labels is None:
        return gamma[:, 1]
    joined = np.flatnonzero(rows[1:] == rows[:-1]) if n else np.zeros(0, np.int64)
    xi = alpha[joined][:, :, None] * a[None] * (e[joined + 1] * beta[joined + 1])[:, None, :] / norm[joined + 1][:, None, None]
    expected = xi.sum(0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[joined], labels[joined + 1]), 1.0)
    return gamma[:, 1], expected - seen


WIDTH = OWN * 4 + 3


@dataclass
class Chains:
    """Documents of a shard: own features and lengths of their lines, and their labels."""

    x: list[np.ndarray]
    size: list[np.ndarray]
    labels: np.ndarray

    @classmethod
    def of(cls, table_: pa.Table | pa.RecordBatch) -> Chains:
        """From (key, quality, size, x), in order of length and key, whatever order the rows came in."""
        if isinstance(table_, pa.RecordBatch):
            table_ = pa.Table.from_batches([table_])
        size = [np.frombuffer(v.as_buffer(), np.float64) for v in table_.column("size")]
        x = [np.frombuffer(v.as_buffer(), np.float32).reshape(-1, OWN) for v in table_.column("x")]
        order = sorted(range(len(x)), key=lambda i: (len(x[i]), keys[i])) if (keys := table_.column("key").to_pylist()) else []
        return cls([x[i] for i in order], [size[i] for i in order], np.array([table_.column("quality")[i].as_py() for i in order], np.int64))

    def batches(self, docs: int = BATCH_DOCS):
        """(features with neighbours, lengths, rows, labels) of runs of documents, each whole."""
        for lo in range(0, len(self.x), docs):
            part = self.x[lo : lo + docs]
            rows = np.repeat(np.arange(len(part)), [len(v) for v in part])
            yield with_neighbours(np.concatenate(part), rows), np.concatenate(self.size[lo : lo + docs]), rows, self.labels[lo : lo + docs]


def descend(chains: Chains, model: Model, share: float, epochs: int = EPOCHS) -> Model:
    """model after some epochs of Adam over the batches of a shard; share is that of good documents in all shards."""
    w, move = model.weights.copy(), model.move.copy()
    m1, m2, step = np.zeros(len(w) + 4), np.zeros(len(w) + 4), 0
    mean, scale = model.mean.astype(np.float32), model.scale.astype(np.float32)
    ready = [((x - mean) / scale, rows, labels) for x, _, rows, labels in chains.batches()]
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(ready)):
            x, rows, labels = ready[k]
            y = labels[rows]
            # Both labels weigh the same, and so does each document, whatever its lines.
            weight = 1.0 / np.bincount(rows)[rows] * np.where(y == 1, 0.5 / share, 0.5 / (1.0 - share))
            weight *= len(weight) / weight.sum()
            p, gap = chain((x @ w.astype(np.float32)).astype(np.float64), move, rows, y)
            g = np.r_[x.T @ ((p - y) * weight).astype(np.float32) / len(x) + L2 * w, (gap / len(x) + L2 * move).ravel()]
            step += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            d = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            w, move = w - d[:-4], move - d[-4:].reshape(2, 2)
    return Model(model.mean, model.scale, w, move)


def calibrate(model: Model, q: np.ndarray, labels: np.ndarray) -> Model:
    """model with the logistic map that fits the labels to the documents' logits, by Newton steps."""
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-(model.slope * q + model.shift)))
        h, r = p * (1 - p) + 1e-6, p - labels
        grad = np.array([(r * q).sum() + 1e-2 * (model.slope - 1.0), r.sum()])
        hess = np.array([[(h * q * q).sum() + 1e-2, (h * q).sum()], [(h * q).sum(), h.sum()]])
        d = np.clip(np.linalg.solve(hess, grad), -1.0, 1.0)
        model.slope, model.shift = float(model.slope - d[0]), float(model.shift - d[1])
    model.slope = max(model.slope, 1e-3)
    return model


def document_logits(model: Model, x: np.ndarray, size: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Logit of each document's length-weighted marginal, from features with neighbours."""
    e = ((x.astype(np.float64) - model.mean) / model.scale) @ model.weights
    return _logit(_aggregate(chain(e, model.move, rows), size, rows, n))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _aggregate(p: np.ndarray, size: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Mean of the marginals of each document's lines, weighted by their length."""
    weight = size + 1.0
    return np.bincount(rows, p * weight, n) / np.maximum(np.bincount(rows, weight, n), 1e-9)


def score_batch(model: Model, column: pa.Array):
    """Score of each text of an Arrow column, in order."""
    out = np.empty(len(column))
    for lo, hi, buf, offs in text_buffers(column):
        if model.constant is not None:
            out[lo:hi] = model.constant
            continue
        x, size, rows = features(buf, offs)
        q = document_logits(model, with_neighbours(x, rows), size, rows, hi - lo)
        out[lo:hi] = 1.0 / (1.0 + np.exp(-(model.slope * q + model.shift)))
    return out


def held_out(doc_id):
    """crc32 of the id as text, modulo FOLDS, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


_FEATURED = "key long, quality int, size binary, x binary"


def _featured(batches):
    """(key, quality, text) -> key, quality, size, x: lengths and own features of each document's lines."""
    for batch in batches:
        for lo, hi, buf, offs in text_buffers(batch.column(2)):
            x, size, rows = features(buf, offs)
            at = np.searchsorted(rows, np.arange(hi - lo + 1))
            cut = lambda v: pa.array([np.ascontiguousarray(v[a:b]).tobytes() for a, b in zip(at, at[1:])], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), cut(size), cut(x)], names=["key", "quality", "size", "x"])


def _moments(batches):
    """Number of lines, sums and sums of squares of their features."""
    total = np.zeros(1 + 2 * WIDTH)
    for batch in batches:
        for x, _, _, _ in Chains.of(batch).batches():
            x = x.astype(np.float64)
            total += np.r_[len(x), x.sum(0), (x * x).sum(0)]
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, shard_docs: int = SHARD_DOCS, rounds: int = ROUNDS) -> Model:
    """Model from the labelled documents outside the held-out fold, at most ``limit`` of them."""
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    data = materialise(rows.select(F.xxhash64("doc_id").alias("key"), "quality", "text").mapInArrow(_featured, _FEATURED), "train-features")
    n, good = data.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    zeros = np.zeros(WIDTH)
    if not 0 < good < n:
        return Model(zeros, np.ones(WIDTH), zeros, np.zeros((2, 2)), constant=good / n if n else 0.5)
    sums = np.sum([r.v for r in data.mapInArrow(_moments, "v array<double>").collect()], axis=0)
    mean = sums[1 : 1 + WIDTH] / sums[0]
    scale = np.sqrt(np.maximum(sums[1 + WIDTH :] / sums[0] - mean * mean, 0.0)) + 1e-6
    # The order in which sums meet must not show in the model.
    mean, scale = np.round(mean, 6), np.round(scale, 6) + 1e-6
    mean[-1], scale[-1] = 0.0, 1.0
    model, share = Model(mean, scale, zeros, np.zeros((2, 2))), good / n
    shards = data.withColumn("shard", F.pmod("key", F.lit(-(-n // shard_docs)))).groupBy("shard")
    for _ in range(rounds):

        def run(part: pa.Table) -> pa.Table:
            new = descend(Chains.of(part), model, share)  # noqa: B023 - each round is collected before the next
            return pa.table({"shard": part.column("shard")[:1].cast(pa.int64()), "docs": pa.array([len(part)], pa.int64()), "v": pa.array([[*new.weights, *new.move.ravel()]], pa.list_(pa.float64()))})

        found = sorted(shards.applyInArrow(run, "shard long, docs long, v array<double>").collect())
        v = np.average([r.v for r in found], axis=0, weights=[r.docs for r in found])
        model = Model(mean, scale, v[:-4], v[-4:].reshape(2, 2))

    def logits(batches):
        for batch in batches:
            chains = Chains.of(batch)
            q = [document_logits(model, x, size, rows, len(y)) for x, size, rows, y in chains.batches()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q) if q else [], pa.float64()), pa.array(chains.labels, pa.int64())], names=["q", "y"])

    pairs = np.array(sorted(map(tuple, data.mapInArrow(logits, "q double, y long").collect())))
    return calibrate(model, pairs[:, 0], pairs[:, 1])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a column text -> docs and the score; a column of that name is replaced."""
    out = docs.drop(column).withColumn(column, F.lit(0.0))
    at = out.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = pa.array(score_batch(model, batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
