"""Training corpus in five stages: quality, lines, near copies, benchmark passages, mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import contamination, lines, mixing, quality, simhash
from tabloom.llm.common import free_name, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more); columns and texts stay as they are."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.score(docs["text"]) >= 0.3)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines found in 10 or more documents; all documents stay and n_chars follows the text."""
    total, gone = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    kept = lines.LineIndex.build(docs, min_docs=10, min_chars=1).clean(docs, lines_col=total, dropped_col=gone)
    changed = F.when(F.col(gone) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group whose fingerprints link at 3 or fewer bits."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited."""
    return contamination.Decontaminator.fit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).clean(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for each pass that a document is taken, numbered in `epoch`; weights 5, 2, 1."""
    return mixing.mixture(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0, seed=6, epoch_col=free_name(docs, "epoch"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("lines", without_common_lines),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("mix", mixed),
]

#: Training and alignment have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
