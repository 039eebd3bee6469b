"""A corpus pipeline of the training-data operators: from documents to packed sequences, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.llm.common import checkpoint_folder
from voltspan.llm.decontaminate import decontaminated
from voltspan.llm.language import accepted
from voltspan.llm.nearcopies import copies_by_both
from voltspan.llm.packing import default_tokenizer, pack
from voltspan.llm.secrets import redact_secrets
from voltspan.llm.simhash import first_of_each
from voltspan.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return accepted(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id. Copies are linked by SimHash (op10: 2 bits, found by its pigeonhole), and by
    a similarity of 0.8 of five-word shingles, which SimHash alone would miss."""
    return first_of_each(docs, copies_by_both(docs, "doc_id", "text"), "doc_id", "text").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text where both are known."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.length("text")).cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024."""
    return pack(docs, "doc_id", "text", default_tokenizer()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]
#: SQL expresses neither the trained model nor the decoding; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again."""
    folder, docs = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(at)
    return docs
