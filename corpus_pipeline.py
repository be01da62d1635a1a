"""Training-data pipeline over `documents`: quality rules, near copies, repeated passages, source mix, packing.

STAGES lists (name, function) in order.  Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `docs`.  Each stage's rows are written as Parquet to the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import jaccard, mixing, packing, repeats, rules
from tilewright.llm.stages import stage
from tilewright.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    return rules.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.75 or more on five-word shingles."""
    return jaccard.one_of_each(docs, percent=75, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that start anywhere else."""
    return repeats.deduplicated_documents(docs, length=200)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources at weights 5, 2, 1 takes them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens."""
    return packing.packed(docs, 2048)


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("repeated_passages", repeated_passages),
          ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

#: Suffix arrays, components and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the last one's rows."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
