"""The corpus pipeline: documents through five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kithline.llm import stages
from kithline.llm.common import table, written

STAGES = [
    ("quality_rules", stages.quality),
    ("line_dedup", stages.lines),
    ("ngram_jaccard_join", stages.near_copies),
    ("decontamination", stages.decontaminate),
    ("bpe_encoding", stages.encode),
]

#: The learned quality verdict can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
