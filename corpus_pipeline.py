"""Corpus pipeline: documents in, packed training sequences out.

Five stages, each calling one operator of ``ivnflow.llm`` on all documents that
the stage before it kept. All but the last return the columns of documents.

Defined results: null, empty and blank texts have no letters and go in the first
stage; rows with a null id are kept or rejected as any other; repeated rows (equal
id and text) are folded to one by the dedup stage; an empty table gives no
pieces; further columns of documents pass through unread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ivnflow.llm.common import table
from ivnflow.llm.host_rules import keep_good
from ivnflow.llm.language_evidence import keep_identified
from ivnflow.llm.nnls_packing import pack_documents
from ivnflow.llm.secret_ownership import redact
from ivnflow.llm.simhash_bktree import one_of_each
from ivnflow.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence identifies (operator 6)."""
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, from hosts that pass them (operator 1)."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class (operator 5)."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced (operator 3)."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences (operator 8)."""
    import public_tokenizers

    # earlier stages leave the executors less room than the operator alone has
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), memo_words=300_000)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("secret_scans", secrets),
    ("packing", packing),
]

#: Language ID, fingerprints and tokens are not SQL; tests/llm/test_pipeline_rows.py holds each stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
