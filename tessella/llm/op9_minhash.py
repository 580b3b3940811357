"""MinHash near-dedup with an LSH forest.

A document's set is its distinct shingles of ``shingle`` words. Equal sets are
one class (their smallest id stands for it). Each class has TREES * DEPTH
MinHash values; tree t orders the classes by its own DEPTH values, and the
classes next to one another in that order, which share the longest prefixes,
are candidates: a class is paired with those up to REACH places on that share
at least MIN_PREFIX values, and in a region where more classes than that share
a prefix the order goes on through the deeper values, so the depth used adapts
to the region. The orders are range-partitioned sorts: a group of near copies
of any size is spread over tasks, no bucket meets in one task, and each tree
gives at most REACH pairs a class.

Candidates whose MinHash estimate is over SLACK standard errors below the
threshold are left out; all others are confirmed on the full sets. Confirmation
goes in rounds, the best estimates of each class first; pairs already joined by
confirmed links need no further look. Components are found by min-label
propagation with pointer jumping.

REACH bounds the neighbours of a class, so a region of more classes has pairs
that no tree brought together. An exact step handles these: a region is a
connected part of the candidate graph; where it has pairs that were no
candidates and holds more than one component, the classes outside its largest
component are held against all its classes on the full sets, in slices of
SLICE by SLICE classes, whatever the region's size.

Defined cases: null, empty and wordless texts have empty sets and are linked
with nothing; a text of fewer words than a shingle has its whole sequence as
one; repeated rows and ids are rows of their own with equal results (a null id
is the smallest and stays null); very long texts are handled whole; no
documents give no rows; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, row_key, table, text_buffers, word_hashes

TREES, DEPTH, MIN_PREFIX, REACH, SLACK, SLICE = 16, 8, 2, 4, 4.5, 2000
_U = np.uint64
VALUES = TREES * DEPTH


def _seeds(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int):
    """Distinct shingle hashes of each row, sorted within it, and where each row's begin."""
    hashes, rows = word_hashes(buf, offs)
    n = len(offs) - 1
    count = np.bincount(rows, minlength=n)
    first = np.r_[0, np.cumsum(count)]
    made = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    start = np.repeat(first[:-1], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    row = np.repeat(np.arange(n), made)
    end = first[row + 1]
    s = np.zeros(len(start), _U)
    for d in range(width):
        at = start + d
        s = mix64(s * _U(3) + np.where(at < end, hashes[np.minimum(at, len(hashes) - 1)], _U(d + 1))) if len(hashes) else s
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.r_[0, np.cumsum(np.bincount(row, minlength=n))]


def minhash(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """VALUES minima of each non-empty set (rows x VALUES, 32 bits)."""
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), VALUES), np.uint32)
    if len(full):
        for j, seed in enumerate(_seeds(VALUES)):
            h = sets * seed
            h ^= h >> _U(29)
            out[:, j] = np.minimum.reduceat((h * _U(0xBF58476D1CE4E5B9)) >> _U(32), at[full]).astype(np.uint32)
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """docs (k1, k2, text) -> k1, k2, n, digest (of the set; null if empty), sig."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in text_buffers(batch.column(2), 1 << 20):
                sets, at = shingle_sets(buf, offs, width)
                size = np.diff(at)
                sig = minhash(sets, at)
                sums = np.r_[_U(0), np.cumsum(mix64(sets))]
                digest = mix64(sums[at[1:]] - sums[at[:-1]]) ^ size.astype(_U)
                where = np.cumsum(size > 0) - 1
                raw = [sig[w].tobytes() if s else None for w, s in zip(where, size, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(digest.view(np.int64), mask=size == 0), pa.array(raw, pa.binary())],
                    names=["k1", "k2", "n", "digest", "sig"],
                )

    return docs.mapInArrow(run, "k1 long, k2 long, n long, digest long, sig binary")


def _trees(batches):
    """(cls, sig) -> tree, label, cls, prints: one row per class and tree; prints are 8 bits of every value."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, VALUES)
        prints = pa.array([r.tobytes() for r in (sig & 255).astype(np.uint8)], pa.binary())
        big = sig.astype(">u4")
        for t in range(TREES):
            label = pa.array([r.tobytes() for r in big[:, t * DEPTH : (t + 1) * DEPTH]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), label, batch.column(0), prints], names=["tree", "label", "cls", "prints"])


def _neighbours(threshold: float):
    """mapInArrow function over a sorted partition: pairs of neighbours, and with null b the rows at the partition's ends."""
    cut = threshold - SLACK * (threshold * (1 - threshold) / VALUES) ** 0.5

    def run(batches):
        tail, head = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree = np.asarray(batch.column(0))
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(n, DEPTH)
            cls = np.asarray(batch.column(2))
            prints = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, VALUES)
            if len(head) < REACH:
                head += [(int(tree[i]), label[i].tobytes(), int(cls[i]), prints[i].tobytes()) for i in range(min(n, REACH - len(head)))]
            if tail is not None:
                tree, label, cls, prints = (np.concatenate(x) for x in zip(tail, (tree, label, cls, prints), strict=True))
            fresh = len(cls) - n
            yield _pairs(tree, label, cls, prints, fresh, cut)
            tail = (tree[-REACH:], label[-REACH:], cls[-REACH:], prints[-REACH:])
        if tail is not None:
            rows = head + [(int(t), l.tobytes(), int(c), p.tobytes()) for t, l, c, p in zip(*tail, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[2] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.float64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                names=["a", "b", "est", "tree", "label", "prints"],
            )

    return run


def _pairs(tree, label, cls, prints, fresh: int, cut: float) -> pa.RecordBatch:
    """Pairs of rows up to REACH apart, the second at fresh or after, that share the tree and MIN_PREFIX values."""
    a, b, est = [], [], []
    for d in range(1, REACH + 1):
        j = np.arange(max(fresh, d), len(cls))
        i = j - d
        good = (tree[i] == tree[j]) & (label[i, :MIN_PREFIX] == label[j, :MIN_PREFIX]).all(1) & (cls[i] != cls[j])
        i, j = i[good], j[good]
        same = (prints[i] == prints[j]).mean(1)
        e = (same - 1 / 256) / (1 - 1 / 256)
        keep = e >= cut
        a.append(np.minimum(cls[i[keep]], cls[j[keep]]))
        b.append(np.maximum(cls[i[keep]], cls[j[keep]]))
        est.append(e[keep])
    n = sum(map(len, a))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(a).astype(np.int64)), pa.array(np.concatenate(b).astype(np.int64)), pa.array(np.concatenate(est)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
        names=["a", "b", "est", "tree", "label", "prints"],
    )


_PAIR = "a long, b long, est double, tree int, label binary, prints binary"


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """classes (cls, sig) -> distinct candidate pairs a < b with est."""
    spark = classes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = classes.mapInArrow(_trees, "tree int, label binary, cls long, prints binary")
    order = rows.repartitionByRange(n, "tree", "label", "cls").sortWithinPartitions("tree", "label", "cls")
    found = materialise(order.mapInArrow(_neighbours(threshold), _PAIR), "forest")
    # The ends of the partitions (2 * REACH rows each) are put in order once more, so no neighbours are missed.
    ends = found.where("b is null").select("tree", "label", F.col("a").alias("cls"), "prints").distinct()
    seams = ends.repartition("tree").sortWithinPartitions("tree", "label", "cls").mapInArrow(_neighbours(threshold), _PAIR)
    both = found.where("b is not null").select("a", "b", "est").unionByName(seams.where("b is not null").select("a", "b", "est"))
    return both.groupBy("a", "b").agg(F.max("est").alias("est"))


def _shares(batches):
    """(a, b, sa, sb) -> a, b, both, na, nb with the sizes of the intersection and of the sets."""
    for batch in batches:
        both, na, nb = [], [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            both.append(int((x[at] == y).sum()))
            na.append(len(x))
            nb.append(len(y))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (both, na, nb))], names=["a", "b", "both", "na", "nb"])


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in text_buffers(batch.column(1), 1 << 20):
                sets, at = shingle_sets(buf, offs, width)
                raw = [sets[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(raw, pa.binary())], names=["cls", "words"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b), sets (cls, words) -> the links: pairs with 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("words").alias("sa")), "a")
    full = left.join(sets.select(F.col("cls").alias("b"), F.col("words").alias("sb")), "b").select("a", "b", "sa", "sb")
    counted = full.mapInArrow(_shares, "a long, b long, both long, na long, nb long")
    return counted.where(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> v, root: for each vertex of a link the smallest vertex that it reaches."""
    ends = links.select(F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("v"))).distinct()
    labels = materialise(ends.select("v", F.col("v").alias("root")), "labels")
    while True:
        # Links between different labels, then each label takes the smallest one beside it.
        la = labels.select(F.col("v").alias("a"), F.col("root").alias("ra"))
        lb = labels.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        open_ = links.join(la, "a").join(lb, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("r"), F.least("ra", "rb").alias("to"))
        hooks = materialise(open_.groupBy("r").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            return labels
        while True:  # pointer jumping: no hook leads to another one
            far = hooks.select(F.col("r").alias("to"), F.col("to").alias("next"))
            jumped = materialise(hooks.join(far, "to", "left").select("r", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("r", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = materialise(labels.join(hooks.withColumnRenamed("r", "root"), "root", "left").select("v", F.coalesce("to", "root").alias("root")), "labels")


def _across(percent: int):
    """Left and right classes (cls, root, words) of a slice -> a link of each left class to each other root within reach."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            sets = [np.frombuffer(x.as_buffer(), _U) for x in right.column("words")]
            size = np.array([len(x) for x in sets])
            owner, values = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
            order = np.argsort(values, kind="stable")
            owner, values = owner[order], values[order]
            other, root = right.column("cls").to_numpy(), right.column("root").to_numpy()
            for cls, own, words in zip(left.column("cls").to_pylist(), left.column("root").to_pylist(), left.column("words"), strict=True):
                words = np.frombuffer(words.as_buffer(), _U)
                lo, hi = np.searchsorted(values, words, "left"), np.searchsorted(values, words, "right")
                count = hi - lo
                at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                hit = np.flatnonzero((both * 100 >= percent * (len(words) + size - both)) & (root != own))
                for i in hit[np.unique(root[hit], return_index=True)[1]]:
                    a.append(min(cls, int(other[i])))
                    b.append(max(cls, int(other[i])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def across_regions(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, slice_: int = SLICE) -> DataFrame:
    """Links between components of a region that no candidate pair could show: a, b."""
    regions = components(pairs.select("a", "b")).select(F.col("v").alias("cls"), F.col("root").alias("region"))
    placed = materialise(regions.join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "regions")
    held = pairs.join(regions.withColumnRenamed("cls", "a"), "a").groupBy("region").agg(F.count(F.lit(1)).alias("seen"))
    per_root = placed.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = per_root.groupBy("region").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("big")).join(held, "region")
    open_ = open_.where((F.col("roots") > 1) & (F.col("seen") < F.col("m") * (F.col("m") - 1) / 2))
    cuts = open_.select("region", F.col("big.root").alias("big"), F.ceil(F.col("m") / slice_).cast("int").alias("nr"), F.ceil((F.col("m") - F.col("big.n")) / slice_).cast("int").alias("nl"))
    members = materialise(placed.join(cuts, "region").join(sets, "cls"), "members")
    key = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.where("root <> big").select("region", key("nl").alias("l"), every("nr").alias("r"), "cls", "root", "words")
    right = members.toDF(*members.columns).select("region", every("nl").alias("l"), key("nr").alias("r"), "cls", "root", "words")
    by = ("region", "l", "r")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_across(percent), "a long, b long")


def near_classes(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """docs (doc_id, text) -> one row per row: k1, k2, n (size of its set), root (smallest id of its component, k1 where it is alone)."""
    source = docs.select(*row_key(), "text")
    sigs = materialise(signatures(source, width), "signatures")
    full = sigs.where("digest is not null")
    # Row keys of the row that stands for each set: the smallest id, then the smallest hash.
    classes = full.groupBy("digest", "n").agg(F.min(F.struct("k1", "k2")).alias("key"), F.first("sig").alias("sig"))
    numbered = materialise(classes.select("digest", "n", "key", "sig", F.xxhash64("digest", "n").alias("cls")), "classes")
    pairs = materialise(candidates(numbered.select("cls", "sig"), percent / 100), "candidates")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    keys = numbered.join(wanted, "cls", "left_semi").select("cls", "key.k1", "key.k2").dropDuplicates(["k1", "k2"])
    texts = source.join(keys, ["k1", "k2"]).select("cls", "text").dropDuplicates(["cls"])
    sets = materialise(texts.mapInArrow(_sets(width), "cls long, words binary"), "sets")
    # First the best candidate of each class as a and as b; then whatever is still apart.
    best = []
    for side in ("a", "b"):
        place = F.row_number().over(Window.partitionBy(side).orderBy(F.desc("est"), "a", "b"))
        best.append(pairs.withColumn("place", place).where("place <= 2").select("a", "b"))
    first = best[0].unionByName(best[1]).distinct()
    links = materialise(confirm(first, sets, percent), "links")
    labels = components(links)
    la = labels.select(F.col("v").alias("a"), F.col("root").alias("ra"))
    lb = labels.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    apart = pairs.join(first, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b")
    more = materialise(confirm(apart, sets, percent), "links")
    links = links.unionByName(more)
    labels = components(links) if not more.isEmpty() else labels
    rest = materialise(across_regions(pairs, labels, sets, percent), "links")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    # From classes back to rows: the smallest id of all classes of a component.
    rooted = numbered.select("digest", "n", "cls", F.col("key.k1").alias("own")).join(labels.withColumnRenamed("v", "cls"), "cls", "left")
    rooted = materialise(rooted.withColumn("root", F.coalesce("root", "cls")), "rooted")
    least = rooted.groupBy("root").agg(F.min("own").alias("least"))
    per_class = rooted.join(least, "root").select("digest", "n", "least")
    return sigs.select("k1", "k2", "n", "digest").join(per_class, ["digest", "n"], "left").select("k1", "k2", "n", F.coalesce("least", "k1").alias("root"))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that with the smallest id, and of rows with that id one; columns as they were.

    Rows with empty sets all stay.
    """
    key = [c.alias(f"__{n}") for c, n in zip(row_key(), ("k1", "k2"), strict=True)]
    found = near_classes(docs.select("doc_id", "text"), width, percent)
    keep = found.where((F.col("root") == F.col("k1")) | (F.col("n") == 0)).groupBy("k1", "k2").agg(F.max("n").alias("__n"), F.max("root").alias("__root"))
    # Of several texts under the smallest id of a component, the one with the smallest hash stays.
    one = keep.groupBy("__root").agg(F.min(F.when(F.col("__n") > 0, F.col("k2"))).alias("__one"))
    keep = keep.join(one, "__root").where((F.col("__n") == 0) | (F.col("k2") == F.col("__one"))).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "__n")
    joined = docs.select("*", *key).join(keep, ["__k1", "__k2"])
    # Repeated rows: one stays where their set is not empty.
    alike = joined.where("__n > 0").dropDuplicates(["__k1", "__k2"])
    return joined.where("__n = 0").unionByName(alike).select(*docs.columns)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    real = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return out.select(real("k1").alias("doc_id"), F.col("n").alias("n_shingles"), real("root").alias("component_id"), (F.col("k1") == F.col("root")).alias("kept"))
