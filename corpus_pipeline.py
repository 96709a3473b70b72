"""A corpus pipeline: each stage takes all that the one before kept, written as Parquet and read again.

Quality rules reject documents, near-duplicate groups leave one document, personal data is replaced, sources are
mixed to target weights (documents may come twice), and what is left is packed into bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keytide.llm.common import Scratch, documents
from keytide.llm.minhash import near_dedup
from keytide.llm.mixing import mixed_documents
from keytide.llm.packing import pack
from keytide.llm.pii import redact
from keytide.llm.quality import quality_filter

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: quality_filter(docs, documents(spark, sf_dir, "labels"))),
    ("minhash_near_dedup", lambda spark, docs, sf_dir: near_dedup(docs)),
    ("pii", lambda spark, docs, sf_dir: redact(docs)),
    ("source_mixing", lambda spark, docs, sf_dir: mixed_documents(docs)),
    ("best_fit_packing", lambda spark, docs, sf_dir: pack(docs)),
]

#: Thresholds, hashes and packing are outside of SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
