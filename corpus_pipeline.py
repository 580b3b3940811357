"""Five-stage corpus pipeline over ``documents``; each stage's output is written as Parquet and read as the next one's input.

Defined cases of every stage: a null or empty text is an empty document, which has no line, no near copy, no
benchmark item and no word, so only the first stage (by the score of an empty text) and the last (which takes no
words of it) can drop it; null ids are ids, the smallest; texts of any length are handled whole; repeated rows get
the same decision, but near_dedup keeps one of those that have words; other columns of documents pass through
under their names, whatever these are, and in the last stage those named size, source_size, target or taken are
replaced; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import op1_lines, op6_mixing, op8_quality, op9_minhash, op10_decontam
from tessella.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line CRF scores under the threshold.

    The model is fitted to the labelled documents of this run; labels of unknown or null ids teach nothing, and without
    labels of both kinds the share of good ones decides for all. Equal texts are kept or dropped together.
    """
    model = op8_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = op8_quality.score(docs, model, "__score")
    return scored.where(scored["__score"] >= op8_quality.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring line templates out of texts; drops documents that lose all their words.

    A recurring line stays in the document with the smallest id (of equal ids, the text with the smallest hash); null and
    empty texts stay as they are; repeated rows count as one document; n_chars follows the new text.
    """
    return op1_lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8): that with the smallest id.

    Of repeated rows and of several texts under that id one stays; null, empty and wordless texts all stay.
    """
    return op9_minhash.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty items and texts match nothing, repeated rows go together."""
    return op10_decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with all their columns and size, source_size, target and taken.

    A null source is a source; rows equal in id and size share their place by any order.
    """
    return op6_mixing.mix(docs, keep=tuple(docs.columns)).where("taken > 0")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixture),
]

#: A trained model and a search over signatures are no SQL; tests/llm/test_pipeline.py holds run() against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
