"""One query for each operator, over its whole table and with production parameters, and the SQL for
those that SQL can express. Operators stay general; the queries reduce their outputs to digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard, licenses, linededup, lm, quality, repetition, resampling, sharding, toxicity, whitening

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels.where(_fold("doc_id", 3) != 1).select("doc_id", "toxic"))
    return toxicity.toxicity(docs, net).select("doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "n_windows")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_read(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"), spans=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_read(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": chat.op1_chat,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_licenses": op5_licenses,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_jaccard": op8_jaccard,
    "op9_lm": op9_lm,
    "op10_repetition": op10_repetition,
    "op11_sharding": sharding.op11_sharding,
    "op12_whitening": whitening.op12_whitening,
    "op13_resampling": resampling.op13_resampling,
}
ORACLES: dict[str, str] = {
    "op1_chat": chat.ORACLE,
    "op2_line_dedup": linededup.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
    "op11_sharding": sharding.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
