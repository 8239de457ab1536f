"""A corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go, secrets are
masked, and what is left becomes token ids."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestone.llm.bpe import encode_table  # noqa: E402
from lodestone.llm.decontaminate import without_contaminated  # noqa: E402
from lodestone.llm.ngram_join import one_of_each  # noqa: E402
from lodestone.llm.secrets import redact_secrets  # noqa: E402
from lodestone.llm.toxicity import without_toxic  # noqa: E402
from lodestone.session import checkpoint_root, ensure_worker_path, table  # noqa: E402


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rejected documents go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the document with the smallest id of each component stays; documents without words are no copies of each other."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets are masked, documents stay."""
    return redact_secrets(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: (doc_id, ids)."""
    import public_tokenizers

    return encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("token_ids", token_ids),
]
#: The classifier and the components of links have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again below spark.checkpoint.dir."""
    ensure_worker_path(spark)
    folder = f"{checkpoint_root(spark)}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
