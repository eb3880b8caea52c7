"""The corpus pipeline: stages over `documents`, each written and read by the next.

Every stage but the last keeps the columns of `documents` and works on all rows that the
one before kept. Defined results, stage by stage: a null or empty text gets a score like
any other (quality), fails the base rules (rules), has no lines and stays (lines), links
with nothing and stays (near_duplicates), and has length 1 (packing). Ties go to the
smaller doc_id. Repeated rows are judged alike and stay, until near_duplicates keeps one
row of each doc_id; rows with a null doc_id are judged too, lose no lines and all stay.
An empty table gives an empty result. Further columns are carried through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnwise.llm import fertility, line_dedup, ngram_join, packing, quality
from urnwise.llm.common import cut, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def stage_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands."""
    return fertility.filter_documents(docs, *fertility.paths())


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those with no line left go."""
    return line_dedup.filter_documents(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each remaining document."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [("quality", stage_quality), ("rules", stage_rules), ("lines", stage_lines), ("near_duplicates", stage_near_duplicates), ("packing", stage_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between two stages, Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name}")
    return docs
