"""The corpus pipeline: quality classifier, near-duplicates, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's result as Parquet into the shared folder and reads it back as the
next one's ``docs``.

Defined results, stage by stage: a null text counts as empty; empty texts have a score like any other, are near
duplicates of nothing and hold no benchmark passage; texts may be of any length. Rows that repeat stay repeated until
the near-duplicates, of which the smallest doc_id stays; ties in scores fall to the same side. A null source is a source.
No documents, labels or benchmark: no rows, all accepted, nothing cut. Columns of documents beyond the known ones pass
through all stages but the last; none of the stages' own columns can clash with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_dedup, quality, token_store
from tidemark.llm.common import shared_path, ship
from tidemark.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8 or more)."""
    ship(spark)
    return near_dedup.distinct_documents(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    ship(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source at its target weight, in a globally shuffled order."""
    ship(spark)
    return mixing.mixed(docs, mixing.tempered_weights(docs)).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    return token_store.digests(token_store.stored(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: Neither the classifier nor the tokenizer can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
