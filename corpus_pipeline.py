"""A corpus pipeline of five stages over ``documents``; each is an operator of ``tessera.llm``.

Each stage takes (spark, documents so far, folder of tables) and returns all that
it keeps, written and read again before the next. Near duplicates are texts
whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Columns beyond ``text`` and ``doc_id`` pass through all stages but the last, whatever their
names. Null and empty texts fail the quality rules. Of repeated rows one is left by the near
duplicates; rows with a null id are never near duplicates. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import best_fit_packing, decontamination, jaccard_join, quality_rules, secret_scans
from tessera.llm.shared import written
from tessera.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    forest = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.without_rejected(docs, forest)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id."""
    return jaccard_join.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    clean = secret_scans.redact(docs, secret_scans.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their bins, a token for each word."""
    return best_fit_packing.pack(docs, best_fit_packing.word_count())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the forest nor the models of secrets: tests hold the stages against brute force.
ORACLE_SQL = None
