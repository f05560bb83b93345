"""A training corpus from ``documents``: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of ``documents``; ``n_chars``, where there is one, follows the text.

Defined cases: those of the operators. Other columns pass the stages untouched, whatever their names. A document loses its
place in line dedup only if it had lines and all of them are repeats; null and empty texts stay until packing, where they
are documents of the end id alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pixelmill.llm import decontaminate, line_dedup, near_dedup, packing, quality, shared

OWN = ("doc_id", "text")


def _apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame], **changed) -> DataFrame:
    """``work`` on the documents with all other columns under names that no operator uses; then their own names again.
    ``changed``: expressions, over what ``work`` returns, that take a column's place."""
    names = {c: c if c in OWN else f"__pm_other_{i}" for i, c in enumerate(docs.columns)}
    out = work(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[(changed[c](F.col(n)) if c in changed else F.col(n)).alias(c) for c, n in names.items()])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go."""
    return _apart(docs, lambda own: quality.classify(own, shared.table(spark, sf_dir, "labels")).where("predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of three lines go, and with them documents of which nothing is left."""
    some = F.col("n_removed") > 0
    follows = lambda n: F.when(some, F.length("text").cast("long")).otherwise(n)
    return _apart(docs, lambda own: line_dedup.dedup(own).where(~some | (F.col("n_removed") < F.col("n_lines"))), n_chars=follows)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest doc_id stays."""
    return _apart(docs, near_dedup.dedup)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _apart(docs, lambda own: decontaminate.clean(own, shared.table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]
#: SQL has no nearest-neighbour vote and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to pieces. What a stage wrote on its way goes once its result is written."""
    docs, path = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with shared.scope(spark) as made:
            docs, new = shared.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.remove(new)
        if path:
            shared.remove(spark, path)
        path = new
    return docs
