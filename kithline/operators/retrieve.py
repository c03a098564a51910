"""IDF-weighted retrieval: scores, ranks, routes and pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.constants import POOL_GROUPS, ROUTE_GROUPS
from kithline.operators.index import usable
from kithline.operators.keys import route


def idf(population: str, count: str) -> str:
    return f"ln(({population} + 1) / cast({count} + 1 as double))"


#: Routes in the order in which they are listed; a family that isn't among them is "other".
ROUTES = sorted({r for g in ROUTE_GROUPS for r in g} | {r for g in POOL_GROUPS for r in g}) + ["other"]
_ROUTE_NAMES = f"filter(array({T.quoted(ROUTES)}), (r, i) -> (shiftright(bits, i) & 1) = 1)"


def _route_bit() -> Column:
    """One bit for the route of a key."""
    bit = F.lit(1 << (len(ROUTES) - 1))
    for i, name in enumerate(ROUTES[:-1]):
        bit = F.when(route(F.col("key")) == name, F.lit(1 << i)).otherwise(bit)
    return bit


def scores(query_keys: DataFrame, postings: DataFrame, stats: DataFrame, population: DataFrame, legacy: bool = False, with_routes: bool = True) -> DataFrame:
    """query_id, candidate_id, score, routes: all records that share a usable key with a query.

    Caps are applied before anything is joined, so the postings of a key are one list
    of its cap's length at most. Lists, not hits, go to the partition of the query,
    and are taken apart and summed there: hits are never shuffled. Sums are whole
    numbers of 1e-12, so they do not depend on the order of rows, and routes are bits
    until the end: both aggregate without objects. Legacy mode counts a key once for
    each occurrence on either side and measures rarity by occurrences.
    """
    count = "tf" if legacy else "df"
    times = " * q_mult * post.mult" if legacy else ""
    keys = usable(stats, legacy).join(population, "country").select("country", "key", F.expr(idf("population", count)).alias("idf"), _route_bit().alias("bit"))
    post = F.struct(F.col("entity_id").alias("id"), "mult") if legacy else F.struct(F.col("entity_id").alias("id"))
    lists = postings.join(keys, ["country", "key"]).groupBy("country", "key").agg(F.first("idf").alias("idf"), F.first("bit").alias("bit"), F.collect_list(post).alias("posts"))
    asked = query_keys.select(F.col("entity_id").alias("query_id"), "country", "key", F.col("weight").alias("q_weight"), F.col("mult").alias("q_mult"))
    hits = (
        asked.join(lists, ["country", "key"]).select("query_id", "q_weight", "q_mult", "idf", "bit", "posts").repartition("query_id")
        .select("query_id", "q_weight", "q_mult", "idf", "bit", F.explode("posts").alias("post"))
        .select("query_id", F.col("post.id").alias("candidate_id"), F.expr(f"cast(round(q_weight * idf{times} * 1e12D) as bigint)").alias("part"), "bit")
    )
    found = [(F.sum("part") / F.lit(1e12)).alias("score")] + ([F.bit_or("bit").alias("bits")] if with_routes else [])
    out = hits.groupBy("query_id", "candidate_id").agg(*found)
    return out.withColumn("routes", F.expr(_ROUTE_NAMES)).drop("bits") if with_routes else out


def by_rank() -> Window:
    """Best score first, then source 2 before 3, then number, then id."""
    return Window.partitionBy("query_id").orderBy(F.desc("score"), F.expr(T.id_order("candidate_id")), "candidate_id")


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Adds rank from 1 on; with k, only the first k (cut before the shuffle's end)."""
    out = scored.withColumn("rank", F.row_number().over(by_rank()))
    return out if k is None else out.where(F.col("rank") <= k)


def relative(scored: DataFrame) -> DataFrame:
    """Adds relative_score: score over the query's best."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("relative_score", F.col("score").cast("double") / F.greatest(F.lit(1e-9), best.cast("double")))


def route_pool(ranks: DataFrame, limit: int = 1000) -> DataFrame:
    """The pool of each query: its first half by rank, then equal shares for the route groups, then by rank again.

    A share passes over what is already in; so shares are taken one after another,
    each as a rank among the rows not yet in.
    """
    if limit < 4:
        return ranks.where(F.col("rank") <= limit)
    half = limit // 2
    share = (limit - half) // len(POOL_GROUPS)
    out = ranks.withColumn("kith_in", F.col("rank") <= half)
    for group in POOL_GROUPS:
        open_ = ~F.col("kith_in") & F.arrays_overlap("routes", F.array(*map(F.lit, group)))
        place = F.row_number().over(Window.partitionBy("query_id", "kith_open").orderBy("rank"))
        out = out.withColumn("kith_open", open_).withColumn("kith_place", place)
        out = out.withColumn("kith_in", F.col("kith_in") | (F.col("kith_open") & (F.col("kith_place") <= share))).drop("kith_open", "kith_place")
    chosen = F.sum(F.col("kith_in").cast("int")).over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "kith_in").orderBy("rank"))
    out = out.withColumn("kith_chosen", chosen).withColumn("kith_place", place)
    return out.where(F.col("kith_in") | (F.col("kith_place") <= limit - F.col("kith_chosen"))).drop("kith_in", "kith_chosen", "kith_place")


def pools(ranks: DataFrame) -> DataFrame:
    """One row a query: candidates, relative scores and routes as arrays in rank order."""
    packed = F.sort_array(F.collect_list(F.struct("rank", "candidate_id", "relative_score", "routes")))
    return relative(ranks).groupBy("query_id").agg(packed.alias("p")).select(
        "query_id", F.expr("transform(p, x -> x.candidate_id)").alias("candidates"), F.expr("transform(p, x -> x.relative_score)").alias("relative_scores"), F.expr("transform(p, x -> x.routes)").alias("routes"),
    )


class CorruptPool(ValueError):
    """The arrays of a stored pool differ in length."""


def unpacked(stored: DataFrame, k: int) -> DataFrame:
    """Rows of stored pools up to rank k; arrays must be of one length."""
    sizes = F.expr("size(candidates) = size(relative_scores) and size(candidates) = size(routes)")
    if not stored.where(~sizes).isEmpty():
        raise CorruptPool("Corrupt candidate pool")
    zipped = F.expr(f"slice(arrays_zip(candidates, relative_scores, routes), 1, {k})")
    return stored.select("query_id", F.posexplode(zipped).alias("i", "z")).select(
        "query_id", F.col("z.candidates").alias("candidate_id"), F.col("z.relative_scores").alias("relative_score"), F.col("z.routes").alias("routes"), (F.col("i") + 1).alias("rank"),
    )
