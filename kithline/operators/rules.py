"""Rule-based linkage: a shared rare name word, or a name word and an address number together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.constants import MAX_POSTING, NEAR_NAME, RARE_POSTING, RULE_THRESHOLD, SHORTLIST, SUPPORT_RANK, SWEEP_THRESHOLDS
from kithline.operators.index import indexed_only

_LONG_NUMBER, _LONG_TOKEN = "key like 'n:%' and length(key) >= 5", "key like 't:%' and length(key) >= 7"


def exploded(keyed: DataFrame) -> DataFrame:
    return keyed.select("entity_id", "country", F.explode("keys").alias("key"))


def rule_postings(keyed: DataFrame, most: int = MAX_POSTING) -> DataFrame:
    """country, key, entity_id, df of indexed name words and long numbers that aren't too common."""
    rows = indexed_only(exploded(keyed)).where(f"key like 't:%' or ({_LONG_NUMBER})")
    stats = rows.groupBy("country", "key").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    return rows.join(stats, ["country", "key"])


def _hits(queries: DataFrame, postings: DataFrame) -> DataFrame:
    return queries.select(F.col("entity_id").alias("query_id"), "country", "key").join(postings.withColumnRenamed("entity_id", "candidate_id"), ["country", "key"])


def shared_keys(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, candidate_id, shared: how many keys both have."""
    return _hits(queries, postings).groupBy("query_id", "candidate_id").agg(F.count("*").alias("shared"))


def supported(queries: DataFrame, postings: DataFrame, most: int) -> DataFrame:
    """query_id, candidate_id, support: pairs of a long name word and a long number that at most ``most`` records share with the query."""
    by = ["country", "word", "number"]

    def paired(rows: DataFrame, name: str) -> DataFrame:
        of = lambda what: F.collect_list(F.when(F.expr(what), F.col("key")))
        lists = rows.groupBy("country", F.col("entity_id").alias(name)).agg(of(_LONG_TOKEN).alias("words"), of(_LONG_NUMBER).alias("numbers"))
        return lists.select("country", name, F.explode("words").alias("word"), "numbers").select("country", name, "word", F.explode("numbers").alias("number"))

    # records meet by word and number together, and only where few enough have both: a list of a word or a number alone is never taken apart by query
    held = paired(postings, "candidate_id")
    held = held.join(held.groupBy(*by).agg(F.count("*").alias("of")).where(F.col("of") <= most).select(*by), by)
    both = paired(queries, "query_id").join(held, by)
    few = F.count("*").over(Window.partitionBy("query_id", "word", "number"))
    return both.withColumn("n", few).where(F.col("n") <= most).groupBy("query_id", "candidate_id").agg(F.count("*").alias("support"))


def rare(queries: DataFrame, postings: DataFrame, most: int = RARE_POSTING) -> DataFrame:
    """query_id, candidate_id of records that share a long name word which few records have."""
    return _hits(queries.where(_LONG_TOKEN), postings.where(F.col("df") <= most)).select("query_id", "candidate_id").distinct()


def candidates(queries: DataFrame, postings: DataFrame) -> DataFrame:
    return rare(queries, postings).union(supported(queries, postings, SUPPORT_RANK).select("query_id", "candidate_id")).distinct()


def pair_score(a: str = "q", b: str = "c") -> str:
    """Jaccard of name words, and a bonus for the longest shared number. Both sides are signature structs."""
    shared = f"array_intersect({a}.numbers, {b}.numbers)"
    bonus = f"case when exists({shared}, n -> length(n) >= 4) then 0.45D when exists({shared}, n -> length(n) >= 3) then 0.30D when size({shared}) > 0 then 0.12D else 0.0D end"
    return f"{T.jaccard(f'{a}.tokens', f'{b}.tokens')} + {bonus}"


def scored(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """query_id, candidate_id, score."""
    side = lambda name, alias: signatures.select(F.col("entity_id").alias(name), F.struct("tokens", "numbers").alias(alias))
    return pairs.join(side("query_id", "q"), "query_id").join(side("candidate_id", "c"), "candidate_id").select("query_id", "candidate_id", F.expr(pair_score()).alias("score"))


def accepted(pairs: DataFrame, threshold: float = RULE_THRESHOLD) -> DataFrame:
    return pairs.where(F.col("score") >= threshold)


def submission(queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for every query: source1_entity_id, matched_entity_ids (best score first, then id as text; empty if none)."""
    lists = chosen.groupBy("query_id").agg(F.expr("array_join(transform(array_sort(collect_set(struct(-score as s, candidate_id as c))), x -> x.c), ',')").alias("ids"))
    return queries.select(F.col("entity_id").alias("query_id")).distinct().join(lists, "query_id", "left").select(F.col("query_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def block_rules(support: DataFrame, near: DataFrame) -> DataFrame:
    """rule, query_id, candidate_id: the five ways to take candidates by support. near: pairs with a close name fingerprint.

    Equal support is ordered by id.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("support"), "candidate_id")
    place = support.withColumn("place", F.row_number().over(order))
    close = support.join(near, ["query_id", "candidate_id"], "left_semi").withColumn("place", F.row_number().over(order))
    named = lambda name, rows: rows.select(F.lit(name).alias("rule"), "query_id", "candidate_id")
    out = named("overlap", support)
    for name, rows in (("two-supports", support.where("support >= 2")), ("top3", place.where("place <= 3")), ("top1", place.where("place = 1")), ("name-top3", close.where("place <= 3"))):
        out = out.unionByName(named(name, rows))
    return out


def near_names(pairs: DataFrame, views: DataFrame, most: int = NEAR_NAME) -> DataFrame:
    """Pairs whose name-word fingerprints differ in at most ``most`` bits."""
    prints = views.select("entity_id", F.expr(T.simhash("array_distinct(tokens)")).alias("print"))
    both = pairs.join(prints.select(F.col("entity_id").alias("query_id"), F.col("print").alias("a")), "query_id").join(prints.select(F.col("entity_id").alias("candidate_id"), F.col("print").alias("b")), "candidate_id")
    return both.where(F.expr(T.hamming("a", "b")) <= most).select("query_id", "candidate_id")


def shortlist(shared: DataFrame, most: int = SHORTLIST) -> DataFrame:
    return shared.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "candidate_id"))).where(F.col("place") <= most)


def sweep_rules(pairs: DataFrame) -> DataFrame:
    """rule, query_id, candidate_id for each threshold and for the best one or three."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("candidate_id"))
    place = pairs.withColumn("place", F.row_number().over(order))
    marks = [F.when(F.col("score") >= t, F.lit(f"{t:.2f}")) for t in SWEEP_THRESHOLDS]
    marks += [F.when(F.expr("place = 1 and score >= 0.60"), F.lit("top1>=0.60")), F.when(F.expr("place <= 3 and score >= 0.45"), F.lit("top3>=0.45"))]
    return place.select("query_id", "candidate_id", F.explode(F.array(*marks)).alias("rule")).where("rule is not null").select("rule", "query_id", "candidate_id")
