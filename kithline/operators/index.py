"""Postings and key statistics of the indexed sources, and how to keep them on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.operators.keys import cap


def indexed_only(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("entity_id").rlike("^S[23]-"))


def populations(records: DataFrame) -> DataFrame:
    """country, population of the indexed records; counted before keys are projected."""
    return indexed_only(records).groupBy(F.trim(F.coalesce("country", F.lit(""))).alias("country")).agg(F.count("*").alias("population"))


def projected(postings: DataFrame, query_keys: DataFrame) -> DataFrame:
    """Postings of keys that some query has; statistics stay exact, as all rows with such a key stay."""
    return postings.join(query_keys.select("country", "key").distinct(), ["country", "key"], "left_semi")


def statistics(postings: DataFrame) -> DataFrame:
    """country, key, df (documents), tf (occurrences), cap."""
    return postings.groupBy("country", "key").agg(F.count("*").alias("df"), F.sum("mult").alias("tf")).withColumn("cap", cap())


def asked_statistics(rows: DataFrame, query_keys: DataFrame) -> DataFrame:
    """The statistics of the keys that some query has: rows are counted before they meet the queries' keys."""
    return statistics(indexed_only(rows)).join(query_keys.select("country", "key").distinct(), ["country", "key"], "left_semi")


def usable(stats: DataFrame, legacy: bool = False) -> DataFrame:
    """Keys within their cap; legacy mode also holds occurrences to it."""
    return stats.where((F.col("df") <= F.col("cap")) & ((F.col("tf") <= F.col("cap")) if legacy else F.lit(True)))


class IndexMismatch(ValueError):
    """A stored index was made from something else."""


def save(postings: DataFrame, stats: DataFrame, population: DataFrame, path: str, signature: str) -> None:
    """Refuses to overwrite; the metadata row is written last."""
    spark = postings.sparkSession
    postings.write.mode("errorifexists").partitionBy("country").parquet(f"{path}/postings")
    stats.write.mode("errorifexists").parquet(f"{path}/stats")
    population.write.mode("errorifexists").parquet(f"{path}/population")
    spark.createDataFrame([(json.dumps({"signature": signature}),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/metadata")


def load(spark: SparkSession, path: str, signature: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stored = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if stored.get("signature") != signature:
        raise IndexMismatch("the index was made from other files or keys")
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("postings", "stats", "population"))


def keys_covered(query_keys: DataFrame, stored_query_keys: DataFrame) -> None:
    """Raises if queries have keys that the projected index was not made for."""
    if not query_keys.select("country", "key").distinct().join(stored_query_keys, ["country", "key"], "left_anti").isEmpty():
        raise IndexMismatch("queries have keys that the index was not made for")
