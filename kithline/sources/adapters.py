"""Records of three sources made from the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as records: the price is the only long number in an address."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('S', 1 + p_partkey % 3, '-', p_partkey) as entity_id", "p_name as business_name",
        "concat(cast(floor(p_retailprice) as bigint), ' ', p_brand, ' ', p_type, ' road ', p_size) as business_address", "if(p_size % 2 = 0, 'US', 'India') as country",
    )


def part_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, true_id: records of sources 2 and 3 with the name, country and whole price of one of source 1."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey % 3 as src", "concat('S', 1 + p_partkey % 3, '-', p_partkey) as id", "p_name", "floor(p_retailprice) as price", "p_size % 2 as c")
    a, b = rows.where("src = 0"), rows.where("src > 0")
    return a.select(F.col("id").alias("query_id"), "p_name", "price", "c").join(b.select(F.col("id").alias("true_id"), "p_name", "price", "c"), ["p_name", "price", "c"]).select("query_id", "true_id")


def part_truth_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, ids: the same as one list a query. Ids are listed by name, price and country before they meet the queries, so links are never shuffled one by one."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey % 3 as src", "concat('S', 1 + p_partkey % 3, '-', p_partkey) as id", "p_name", "floor(p_retailprice) as price", "p_size % 2 as c")
    by = ["p_name", "price", "c"]
    lists = rows.where("src > 0").groupBy(*by).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    found = rows.where("src = 0").select(F.col("id").alias("query_id"), *by).distinct().join(lists, by)
    # a key that comes twice has the links of both rows
    return found.groupBy("query_id").agg(F.collect_list("ids").alias("l")).select("query_id", F.expr("if(size(l) = 1, l[0], array_distinct(flatten(l)))").alias("ids"))


def part_truth_shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same as query_id and g, which says whose links a query has, and g and ids: queries with the same links share a list."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey % 3 as src", "concat('S', 1 + p_partkey % 3, '-', p_partkey) as id", "p_name", "floor(p_retailprice) as price", "p_size % 2 as c")
    by = ["p_name", "price", "c"]
    lists = rows.where("src > 0").groupBy(*by).agg(F.collect_set("id").alias("ids"))
    named = rows.where("src = 0").groupBy(F.col("id").alias("query_id")).agg(F.sort_array(F.collect_set(F.struct(*by))).alias("g"))
    shared = named.select("g").distinct().select("g", F.explode("g").alias("b")).select("g", "b.*").join(lists, by)
    return named, shared.groupBy("g").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: the first six words as name, the next twelve as address, the language as country."""
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").where("doc_id is not null").select(
        F.expr("concat('S', 1 + doc_id % 3, '-', doc_id)").alias("entity_id"), F.array_join(F.slice(words, 1, 6), " ").alias("business_name"), F.array_join(F.slice(words, 7, 12), " ").alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
    )


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: the whole text as name, no address."""
    return table(spark, sf_dir, "documents").where("doc_id is not null").selectExpr("concat('S', 1 + doc_id % 3, '-', doc_id) as entity_id", "text as business_name", "'' as business_address", "coalesce(lang, '') as country")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as records; the name serves as address too, for its zero-padded number."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "concat('S', 1 + c_custkey % 3, '-', c_custkey) as entity_id", "c_name as business_name", "c_name as business_address", "n_name as country"
    )
