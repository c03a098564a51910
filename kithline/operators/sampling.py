"""Stratified splits and samples: counts by stratum as the quotas say, members by md5 order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.constants import DEV_SAMPLE, HOLDOUT_FRACTION, SEED

def shuffled(column: str, seed: int = SEED) -> Column:
    """A fixed order that has nothing to do with the ids'."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(column)))


def place(by: list[str], column: str, seed: int = SEED) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(shuffled(column, seed), column))


def split(entities: DataFrame, fraction: float = HOLDOUT_FRACTION, seed: int = SEED) -> DataFrame:
    """entities: source1_entity_id, country, match_count. Adds bucket and split: a share of each stratum, half to even, and one of ten or more, is valid."""
    rows = entities.withColumn("country", F.expr("if(trim(country) = '' or country is null, '<EMPTY>', trim(country))")).withColumn("bucket", F.expr(T.match_bucket("match_count")))
    size = F.count("*").over(Window.partitionBy("country", "bucket"))
    rows = rows.withColumn("n", size).withColumn("take", F.expr(f"least(n, greatest(bround(n * {fraction}D), if(n >= 10, 1, 0)))"))
    return rows.withColumn("split", F.when(place(["country", "bucket"], "source1_entity_id", seed) <= F.col("take"), "valid").otherwise("train")).drop("n", "take")


def dev_sample(rows: DataFrame, size: int = DEV_SAMPLE, seed: int = SEED) -> DataFrame:
    """Adds dev_sample: about ``size`` of the valid rows, in proportion to strata.

    A stratum whose share rounds to none gets one row, as long as the strata before
    it leave room. All strata before it had their share or one row while there was
    room, so the room is a running sum over strata in order.
    """
    everything, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("country", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        rows.where("split = 'valid'").groupBy("country", "bucket").agg(F.count("*").alias("n"))  # strata are few
        .withColumn("share", F.bround(F.col("n") * F.lit(size) / F.sum("n").over(everything)).cast("bigint"))
        .withColumn("used", F.coalesce(F.sum(F.greatest(F.least("n", "share"), F.lit(1))).over(before), F.lit(0)))
        .select("country", "bucket", F.when((F.col("share") == 0) & (F.col("used") < size), 1).otherwise(F.col("share")).alias("quota"))
    )
    at = place(["country", "bucket", "split"], "source1_entity_id", seed + 1)
    out = rows.withColumn("kith_at", at).join(quotas, ["country", "bucket"], "left").withColumn("dev_sample", F.expr("split = 'valid' and kith_at <= coalesce(quota, 0)"))
    # shares that were rounded up may come to more than size: the first ids stay
    first = out.where("dev_sample").select("source1_entity_id").orderBy("source1_entity_id").limit(size).withColumn("kith_first", F.lit(True))
    out = out.join(first, "source1_entity_id", "left").withColumn("dev_sample", F.col("dev_sample") & F.coalesce("kith_first", F.lit(False))).drop("kith_first")
    return out.drop("kith_at", "quota")


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("country", "bucket").agg(F.count("*").alias("entities"), F.expr("count_if(split = 'valid')").alias("valid"), F.expr("count_if(split = 'train')").alias("train"))


def strata(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, available: strata are country, bucket and the like, so they are few."""
    return rows.groupBy(*by).agg(F.count("*").alias("available"))


def allocated(groups: DataFrame, by: list[str], size: int, least: int = 0) -> DataFrame:
    """groups and quota: size rows dealt to strata (by, available) in proportion.

    Whole shares come first, ``least`` rows at least. What is then missing, or too
    much, is made up by single rows: each stratum offers its next rows with the gap
    that its share would still have, and the offers with the largest gaps win. Equal
    gaps go to the stratum that is last in order.
    """
    total = groups.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("n")).first()["n"]
    if not 0 < size <= total:
        raise ValueError(f"{size} of {total} rows can't be chosen")
    every = Window.partitionBy(F.lit(0))
    start = (
        groups.withColumn("share", F.col("available") * F.lit(size) / F.lit(total)).withColumn("quota", F.least("available", F.greatest(F.lit(least), F.floor("share"))))
        .withColumn("off", F.lit(size) - F.sum("quota").over(every))
    )
    offers = start.where("off <> 0").withColumn("step", F.explode(F.expr("sequence(0L, abs(off) - 1)"))).where("off < 0 or quota + step < available")
    gap = F.expr("if(off > 0, share - (quota + step), (quota - step) - share)")
    best = F.row_number().over(every.orderBy(gap.desc(), *(F.desc(c) for c in by)))
    steps = offers.withColumn("place", best).where("place <= abs(off)").groupBy(*by).agg(F.sum(F.signum("off")).cast("bigint").alias("more"))
    return start.join(steps, by, "left").select(*by, "available", (F.col("quota") + F.coalesce("more", F.lit(0))).alias("quota"))


def take_quotas(rows: DataFrame, by: list[str], quotas: DataFrame, column: str, seed: int = SEED) -> DataFrame:
    """That many rows of each stratum (by, quota), by md5 order."""
    return rows.withColumn("kith_at", place(by, column, seed)).join(quotas.select(*by, "quota"), by).where("kith_at <= quota").drop("kith_at", "quota")


def membership(split_rows: DataFrame, partition: str, size: int, without: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """size rows of a side of the split (of its dev sample, but for the train side), by largest remainders over country and bucket; ids in ``without`` (a pilot's) are left out."""
    rows = split_rows.where(F.col("split") == partition)
    if partition != "train":
        rows = rows.where(F.col("dev_sample").cast("string").isin("1", "true"))
    if without is not None:
        rows = rows.join(without.select("source1_entity_id").distinct(), "source1_entity_id", "left_anti")
    by = ["country", "bucket"]
    return take_quotas(rows, by, allocated(strata(rows, by), by, size), "source1_entity_id", seed)


def select_pilot(views: DataFrame, truth: DataFrame, size: int, seed: int = SEED) -> DataFrame:
    """A pilot over country, match bucket, scripts of the name, and whether the core name is common (three or more in the country)."""
    core = F.array_join("tokens", " ")
    same = F.count("*").over(Window.partitionBy("country", "core"))
    n = truth.groupBy("query_id").agg(F.countDistinct("true_id").alias("match_count"))
    rows = (
        views.select("entity_id", "country", "scripts", core.alias("core")).withColumn("same", same).join(n.withColumnRenamed("query_id", "entity_id"), "entity_id", "left").na.fill(0, ["match_count"])
        .withColumn("bucket", F.expr(T.match_bucket("match_count"))).withColumn("common", F.expr("if(core <> '' and same >= 3, 'common', 'other')"))
    )
    by = ["country", "bucket", "scripts", "common"]
    return take_quotas(rows, by, allocated(strata(rows, by), by, size, 1), "entity_id", seed)


def per_group(rows: DataFrame, by: list[str], n: int, column: str, seed: int = SEED) -> DataFrame:
    """The first n rows of each group by md5 order."""
    return rows.withColumn("kith_at", place(by, column, seed)).where(F.col("kith_at") <= n).drop("kith_at")
