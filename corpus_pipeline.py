"""A corpus from raw documents to a training mix, in five stages.

Each stage takes the rows its predecessor kept, and all but the last return the
columns of `documents`:

1. language_id drops documents of no known language;
2. jaccard_join keeps one document of each group of near copies;
3. decontaminate drops documents that hold benchmark passages;
4. secret_scan masks live secrets inside the texts;
5. mix_sources returns the documents of the mix with their number of copies.

Defined results: a document whose text is null, empty or without letters has no known
language and goes in the first stage; null ids, sources and languages are kept as they
are, null sources being one source; rows alike in all columns are copies, of which the
second stage keeps one; extra columns are carried whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sonolith.llm import decontaminate, jaccard, language, mixing, secrets
from sonolith.llm.common import shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate_stage),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

#: Hash sketches, sampling and connected components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
