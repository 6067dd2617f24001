"""The corpus pipeline: raw documents to token ids of a clean, mixed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stareflow.llm.bpe import token_ids
from stareflow.llm.common import stored
from stareflow.llm.mixing import mixed_documents
from stareflow.llm.ngram_join import one_of_each_group
from stareflow.llm.quality import good_documents
from stareflow.llm.secrets import without_secrets

#: (name, function) in order; each takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality_rules", good_documents),
    ("ngram_jaccard_join", one_of_each_group),
    ("secret_scan", without_secrets),
    ("mix_sources", mixed_documents),
    ("byte_bpe", token_ids),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
