"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes the documents that the one before it kept, written as Parquet
and read again. All but the last return the columns of ``documents``. Documents
with a null or empty text count as empty, rows that repeat an id are told apart
as each stage says, and empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cordage.llm import decontaminate, neardup, packing, quality, secrets
from cordage.llm.queries import tokenizer_path
from cordage.llm.shared import passing_tables, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on their labels, does not reject.

    Empty texts have its prior score and repeated rows fare alike; without labels nothing is rejected.
    """
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates (five words, similarity 0.8).

    Texts without words are near none and stay, as does one row of an id and text that repeat, and of equal texts without an id.
    """
    return neardup.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; empty texts hold none, and rows of one id go together."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark in each text that holds them; null texts stay null."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, none of which crosses documents; an empty text is its end token alone."""
    return packing.packed_digest(docs, tokenizer_path(), end_id=1, longest=2048)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: SQL expresses neither the classifiers nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result but the last is written as Parquet and read again.

    Once it is written, what the stage had stored on the way is removed.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with passing_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
