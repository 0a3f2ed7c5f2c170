"""A corpus from raw documents, stage by stage; each stage reads what the one before it has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certloom.llm import common, decontamination, line_dedup, mixing, near_dedup, toxicity


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars being that of the text as it is now."""
    n_chars = F.length("text").cast("bigint").alias("n_chars")
    return docs.select(*[n_chars if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely toxic than not go."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the last of them alone."""
    return _as_documents(line_dedup.dedup_lines(docs)[0], docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.dedup(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; passages of the benchmark in others are cut out."""
    return _as_documents(decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked weights, with n_tokens, weight and n_copies (1 or more)."""
    return mixing.mix_documents(docs).where("n_copies > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("mixing", sample_mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Ordinal regression, near duplicates and sampling are beyond SQL.
ORACLE_SQL = None
