"""The stages of the corpus pipeline: each keeps the columns of documents, but for the last.

Every stage looks at all rows it is given, and what it decides shows in its
result: rejected, copied and contaminated documents go, repeated chunks leave the
texts, and the last stage returns token ids and the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.llm.common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    from kithline.llm import quality as rules

    return rules.keep(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks that an earlier document has."""
    from kithline.llm import line_dedup

    cleaned = line_dedup.clean(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    from kithline.llm import jaccard_join

    return jaccard_join.distinct(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    from kithline.llm import decontaminate as benchmark

    return benchmark.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and hash, and the decoded text."""
    from kithline.llm.bpe_automaton import encode_texts

    return encode_texts(docs, with_ids=True)
