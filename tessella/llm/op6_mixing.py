"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every source gets a word budget. Whole epochs come first: each document is
taken floor(target / size of the source) times. The rest of the budget goes to
the documents with the smallest exponential keys -ln(u) / quality, where u is
uniform in the document's id, until the prefix sum of sizes meets the budget;
the document at the boundary gives only the words that are left. The quality
weight falls with odd signs in the text and with an odd mean word length, or is
any expression that the caller gives.

A prefix sum over a source that holds a third of all rows never meets in one
task: keys are binned (``BINS`` bins a level, two levels), bin totals are
aggregated before the shuffle, and only rows in the one boundary bin of each
source (about 1 in BINS**2 of its rows) are ordered one by one.

Defined cases: null or empty text has size 0 and takes 0 words; a null source
is a source of its own, last in order; repeated rows are separate rows of equal
rank, and rows equal in all they are ranked by share their place by any order;
no rows give no rows; very long texts are read whole. Of the input, only doc_id,
text, source and the columns to keep are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BINS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Characters that prose has few of: no letters, marks, white space or stops.
ODD = r"""[^\p{L}\p{M}\x20\x09-\x0D.,;:!?'"()-]"""


def quality_weight(text: Column, size: Column) -> Column:
    """Weight in [0.25, 1]: the share of text free of odd characters (0 from a quarter of them on), less for mean word lengths away from 5."""
    length = F.length(text)
    mean = length / F.greatest(size, F.lit(1))
    clean = F.greatest(F.lit(0.0), 1.0 - 4.0 * F.regexp_count(text, F.lit(ODD)).cast("double") / F.greatest(length, F.lit(1)))
    return F.coalesce(F.greatest(F.lit(0.25), clean / (1.0 + F.abs(mean - 5.0) / 10.0)), F.lit(0.25))


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from the first 13 hex digits of the id's MD5."""
    n = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10)
    return (n.cast("double") + 0.5) / float(16**13)


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with one row per source -> source, source_size, target.

    Sharing by weight with caps and resharing the excess ends where each target is
    min(cap, level * weight). Sources are capped in ascending order of cap / weight,
    so the level is found from running sums, without a loop. The windows run over one row per
    source, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = sources.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("level", (F.sum(F.col("source_size")).over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("place", F.row_number().over(by_ratio))
    # The level holds from the first source that it leaves below its cap.
    t = t.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _bin(key: Column, bins: int) -> Column:
    return F.least(F.floor(key * bins), F.lit(bins - 1)).cast("int")


MIXED = ("size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, bins: int = BINS, weight: Column | None = None, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """docs (doc_id, text, source) -> the columns in keep and size, source_size, target, taken.

    weight: the quality weight of a row, an expression over docs' text and the column size. Of the columns to keep
    those with a name of MIXED are replaced.
    """
    text, kept = F.col("text"), [c for c in keep if c not in MIXED]
    sized = docs.select("doc_id", "source", "text", F.struct(*kept).alias("__keep")).withColumn("size", word_count(text))
    q = quality_weight(text, F.col("size")) if weight is None else weight
    key = -F.log(uniform(F.col("doc_id"))) / q
    rows = materialise(sized.select("doc_id", "source", "size", (key / (key + 1.0)).alias("rank_key"), "__keep"), "mix-rows")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    # One row a source: written out so that what follows plans with their true size.
    budgets = materialise(per_source.select(
        "source", "source_size", "target",
        F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long").alias("epochs"),
    ).withColumn("budget", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))), "mix-budgets")

    b1 = _bin(F.col("rank_key"), bins)
    b2 = F.least(F.floor(F.col("rank_key") * bins * bins) - F.floor(F.col("rank_key") * bins) * bins, F.lit(bins - 1)).cast("int")
    marked = rows.withColumn("b1", b1).withColumn("b2", F.greatest(b2, F.lit(0)))

    def boundary(level: DataFrame, name: str, start: Column) -> DataFrame:
        """Of each source, the bin in which the running sum passes the budget, and the sum before it."""
        run = Window.partitionBy("source").orderBy(name)
        sums = level.withColumn("upto", F.sum("s").over(run)).join(level_budget, F.col("source").eqNullSafe(F.col("bs")))
        passed = sums.where(start + F.col("upto") > F.col("budget"))
        return passed.groupBy("source").agg(F.min_by(F.struct(F.col(name).alias("cut"), (start + F.col("upto") - F.col("s")).alias("before")), name).alias("x")).select("source", "x.*")

    level_budget = budgets.select(F.col("source").alias("bs"), "budget")
    cut1 = boundary(marked.groupBy("source", "b1").agg(F.sum("size").alias("s")), "b1", F.lit(0))
    cut1 = materialise(cut1.select(F.col("source").alias("s1"), F.col("cut").alias("cut1"), F.col("before").alias("before1")), "mix-cut")
    in1 = marked.join(cut1, F.col("source").eqNullSafe(F.col("s1")) & (F.col("b1") == F.col("cut1")))
    cut2 = boundary(in1.groupBy("source", "b2", "before1").agg(F.sum("size").alias("s")), "b2", F.col("before1"))
    cut2 = materialise(cut2.select(F.col("source").alias("s2"), F.col("cut").alias("cut2"), F.col("before").alias("before2")), "mix-cut")

    limits = (
        budgets.join(cut1, F.col("source").eqNullSafe(F.col("s1")), "left").join(cut2, F.col("source").eqNullSafe(F.col("s2")), "left")
        .select(F.col("source").alias("s0"), "source_size", "target", "epochs", "budget", "cut1", "cut2", "before2")
    )
    # Written out too: the joins above would be taken for large, and the rows with all that is kept be shuffled by source.
    limits = materialise(limits, "mix-limits")
    full = marked.join(limits, F.col("source").eqNullSafe(F.col("s0")))
    # Without a cut the budget is never passed: every document is inside it.
    inside = F.col("cut1").isNull() | (F.col("b1") < F.col("cut1")) | ((F.col("b1") == F.col("cut1")) & (F.col("b2") < F.col("cut2")))
    at = (F.col("b1") == F.col("cut1")) & (F.col("b2") == F.col("cut2"))
    at = F.coalesce(at, F.lit(False))
    placed = full.withColumn("at", at).withColumn("extra", F.when(F.coalesce(inside, F.lit(False)), F.col("size")).otherwise(F.lit(0)))
    run = Window.partitionBy("source").orderBy("rank_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("at").withColumn("extra", F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - F.col("before2") - F.coalesce(F.sum("size").over(run), F.lit(0)))))
    out = placed.where(~F.col("at")).unionByName(edge)
    return out.select("__keep.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of the whole documents table."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
k0 AS (
  SELECT doc_id, source, size,
         -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
         / coalesce(greatest(0.25, greatest(0.0, 1.0 - 4.0 * CAST(len(regexp_extract_all(text, '[^\\p{L}\\p{M}\\x20\\x09-\\x0D.,;:!?''"()-]')) AS DOUBLE) / greatest(length(text), 1))
                                 / (1.0 + abs(CAST(length(text) AS DOUBLE) / greatest(size, 1) - 5.0) / 10.0)), 0.25) AS k
  FROM d),
k AS (SELECT doc_id, source, size, k / (k + 1.0) AS k FROM k0),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, CAST(source_size * 3 AS DOUBLE) AS cap,
         CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS w
  FROM s),
l AS (
  SELECT *, cap / w AS ratio, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS place,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         coalesce(least(cap, (SELECT arg_min(level, place) FROM l AS m WHERE m.ratio >= m.level) * w), cap) AS target
  FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM t),
r AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs,
         greatest(0, CAST(round(b.target) AS BIGINT) - b.epochs * b.source_size) AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, budget - before)) AS BIGINT) AS taken
FROM r
"""
