"""From documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. The first four return the columns of
documents; the last returns the ids of each document that is left, with digests.

Null and empty texts have nothing that could be judged, so the first stage lets them go; without trusted
documents it keeps all others. Where later stages are given such texts, they keep them.
Of rows with equal ids and texts the third stage keeps one, the least in the other columns; rows without
an id are linked to nothing and stay, as do different texts of one id that are not alike. An empty table
goes through as one. Columns beside those of documents are kept up to the last stage. No SQL expresses the
first, third and last stage, so there is none for the whole; the tests hold it against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import bpe, decontaminate, jaccard, linededup, quality
from logweave.llm.queries import tokenizer_path
from logweave.llm.text import staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is out of the range of trusted text in their language go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share go, but in the one of the largest id."""
    return linededup.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 connect, the one of the smallest id stays."""
    return jaccard.one_of_each_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of what is left."""
    return bpe.encode_texts(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding", tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
