"""A corpus pipeline of five stages, each over all that the stage before kept.

1. toxicity: rows that the clause grammar scores at one half or more go.
2. simhash: of each group of near copies, linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the
   document with the least doc_id stays. SimHash and its index retrieve, and bands of min-hashes what lies out of
   its reach (at 0.8 about ten of 64 bits differ); the shingles decide (``near_copies.py``).
3. suffix_dedup: bytes in repeats of 100 bytes and more go where they also start earlier; a document of which nothing
   is left goes.
4. mixing: sources are taken towards their target weights; a document may come twice or in part.
5. packing: what is left is cut and packed into windows of 1024 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.mixing import mixed_documents
from loomtext.llm.near_copies import drop_near_copies
from loomtext.llm.packing import pack_documents
from loomtext.llm.runtime import bounded_batches, drop_dir, fresh_dir
from loomtext.llm.suffix_dedup import deduped_documents
from loomtext.llm.toxicity import drop_toxic, learn


@bounded_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@bounded_batches
def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, shingle=5, similarity=0.8)


@bounded_batches
def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduped_documents(docs)


@bounded_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


@bounded_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash", simhash),
    ("suffix_dedup", suffixes),
    ("mixing", mixing),
    ("packing", packing),
]

#: No stage but the third has an SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again, and goes when the next one
    is there. Columns of other names go along; null, empty, very long and repeated texts, null and repeated doc_ids and empty
    tables have the results that the stages' operators define."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = fresh_dir(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            drop_dir(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
