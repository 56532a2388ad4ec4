"""Documents to a training mix, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns documents. Between stages the documents are written and read again. All
but the last stage return the columns of ``documents``; the last adds what the mix
takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.decontamination import without_benchmark
from newsloom.llm.line_dedup import without_repeats
from newsloom.llm.mixing import mixed_documents
from newsloom.llm.quality_rules import keep_good
from newsloom.llm.simhash_groups import one_per_group
from newsloom.sources.workspace import write_through


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, if it is there, as long as the texts now are."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(without_repeats(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
]

# Patience alignment and SimHash groups are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_through(docs, name.replace(" ", "-"))
    return docs
