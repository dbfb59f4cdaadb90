"""The corpus pipeline: raw documents to shards in five stages, four of them numbered operators.

Stage 2 links by SimHash fingerprints of 5-word shingles, members kept by an exact Jaccard of 0.8; what 64 bits leave apart is found by
MinHash buckets under the same check (see `minhash.py`).

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet
and reads again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doorlens.llm import decontaminate, minhash, mixing, quality, sharding
from doorlens.session import land


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines that are their host's furniture."""
    return quality.apply_quality_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word Jaccard of 0.8 or more, the smallest doc_id."""
    return minhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark within the edit budget."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's words at its target: a document once per pass over it, with the words that pass takes."""
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix_sources", mixed),
    ("shard_interleaved", sharded),
]

#: Fingerprints, edit distances and seeded draws have no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs
