"""Derived columns of a record, computed once before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.unicode import forms

ENTITY = ["entity_id", "business_name", "business_address", "country"]


def with_views(records: DataFrame) -> DataFrame:
    """entity_id, country (trimmed) and all forms, tokens, numbers, skeletons and grams that keys and features use."""
    base = records.select(
        "entity_id", F.trim(F.coalesce("country", F.lit(""))).alias("country"), F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("address"),
    ).withColumn("f", forms(F.col("name"), F.col("address"))).select("entity_id", "country", "name", "address", "f.*")
    return (
        base.withColumn("tokens", F.expr(T.core_tokens("name_cf")))
        .withColumn("numbers", F.expr(T.numbers("address")))
        .withColumn("is_ascii", F.expr("name rlike '^[\\\\x00-\\\\x7F]*$'"))
        .withColumn("skeleton_all", F.expr(T.consonant_skeleton("name_folded")))
        .withColumn("core_skeleton", F.expr(T.consonant_skeleton("name_core_folded")))
        .withColumn("address_all", F.expr(T.address_words("address_folded")))
        .withColumn("address_words", F.expr(T.address_content("address_all")))
        .withColumn("address_numbers", F.expr(T.address_numbers("address_all")))
    )


def pair_view(views: DataFrame) -> DataFrame:
    """entity_id, country and what pair features need of a record, as one struct column ``view``."""
    return packed_view(views).withColumn("view", unpacked_view())


def packed_view(views: DataFrame) -> DataFrame:
    """entity_id, country and what ``unpacked_view`` makes the pair view of: no words or grams that the name holds already."""
    return views.select("entity_id", "country", F.struct(F.col("name_core_folded").alias("name"), F.col("core_skeleton").alias("skeleton"), F.col("address_words").alias("address"), F.col("address_numbers").alias("numbers")).alias("view"))


def unpacked_view() -> Column:
    return F.struct(
        F.col("view.name").alias("name"), F.expr("array_distinct(filter(split(view.name, ' '), w -> w <> ''))").alias("tokens"), F.expr(T.grams("view.name")).alias("name_grams"),
        F.expr(T.grams("view.skeleton")).alias("skeleton_grams"), F.col("view.address").alias("address"), F.col("view.numbers").alias("numbers"),
    )


def signature(views: DataFrame) -> DataFrame:
    """entity_id, country, distinct core tokens and numbers of two digits or more, in order."""
    return views.select("entity_id", "country", F.array_distinct("tokens").alias("tokens"), F.expr("array_distinct(filter(numbers, n -> length(n) >= 2))").alias("numbers"))
