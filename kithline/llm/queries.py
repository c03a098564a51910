"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kithline.llm import decontaminate, jaccard_join, line_dedup, suffix_dedup
from kithline.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm.bpe_automaton import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm.suffix_dedup import cut

    return cut(table(spark, sf_dir, "documents")).drop("kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm.line_dedup import report

    return report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm.decontaminate import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kithline.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe_automaton": op4_bpe_automaton,
    "op5_token_counts": op5_token_counts,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op6_jaccard_join": jaccard_join.ORACLE_SQL,
    "op7_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op9_decontamination": decontaminate.ORACLE_SQL,
}
