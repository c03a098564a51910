"""Pair features, pair rank and the fixed-weight logistic score, as native expressions over two views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.constants import BASE_FEATURES, FEATURES, ROUTE_GROUPS

_SHARED = "array_intersect(q.numbers, c.numbers)"
_BASE = {
    "name_exact": "cast(q.name <> '' and q.name = c.name as double)",
    "name_tokens": T.jaccard("q.tokens", "c.tokens"),
    "name_chars": T.dice("q.name_grams", "c.name_grams"),
    "name_skeleton": T.dice("q.skeleton_grams", "c.skeleton_grams"),
    "address_words": T.jaccard("q.address", "c.address"),
    "address_containment": "size(array_intersect(q.address, c.address)) / cast(greatest(1, least(size(q.address), size(c.address))) as double)",
    "number_long": f"cast(exists({_SHARED}, n -> length(n) >= 4) as double)",
    "number_medium": f"cast(exists({_SHARED}, n -> length(n) = 3) as double)",
    "number_short": f"cast(size({_SHARED}) > 0 as double)",
    "number_conflict": f"cast(size(q.numbers) > 0 and size(c.numbers) > 0 and size({_SHARED}) = 0 as double)",
    "missing_address": "cast(size(q.address) + size(q.numbers) = 0 or size(c.address) + size(c.numbers) = 0 as double)",
}
_DERIVED = {
    "name_best": "greatest(name_tokens, name_chars, name_skeleton)", "name_address_interaction": "greatest(name_tokens, name_chars, name_skeleton) * address_words",
    "skeleton_address_interaction": "name_skeleton * address_words", "number_name_interaction": "greatest(name_tokens, name_chars, name_skeleton) * number_short",
    "name_length_ratio": "least(length(q.name), length(c.name)) / cast(greatest(1, length(q.name), length(c.name)) as double)", "retrieval_relative_score": "relative_score",
    "route_count": "cast(" + " + ".join(f"if(arrays_overlap(routes, array({T.quoted(g)})), 1, 0)" for g in ROUTE_GROUPS) + " as double)", "source3": "cast(candidate_id like 'S3-%' as double)",
}
_NAME = "greatest(name_tokens, name_chars, 0.85D * name_skeleton)"
RANK_NAME = f"2.5D * {_NAME} + 0.5D * name_exact"
_ADDRESS = "(0.9D * address_words + 0.3D * address_containment)"
RANK = f"{RANK_NAME} + {_ADDRESS} + 0.65D * number_long + 0.4D * number_medium + 0.15D * number_short + 0.5D * {_NAME} * {_ADDRESS} - 0.3D * number_conflict"


class MissingCandidate(ValueError):
    """A pool names a record that isn't there."""


def base_features(pairs: DataFrame, views: DataFrame, strict: bool = False) -> DataFrame:
    """pairs (query_id, candidate_id and more) with q, c and the 11 base features. Unknown candidates are left out, or raise in strict mode."""
    side = lambda name, alias: views.select(F.col("entity_id").alias(name), F.col("view").alias(alias))
    if strict and not pairs.select("candidate_id").distinct().join(views, F.col("candidate_id") == F.col("entity_id"), "left_anti").isEmpty():
        raise MissingCandidate("pools name records that aren't there")
    return _compared(pairs.join(side("query_id", "q"), "query_id").join(side("candidate_id", "c"), "candidate_id"))


def _compared(both: DataFrame) -> DataFrame:
    return both.withColumns({k: F.expr(_BASE[k]) for k in BASE_FEATURES})


def all_features(pairs: DataFrame, views: DataFrame, strict: bool = False) -> DataFrame:
    """pairs with relative_score and routes: query_id, candidate_id and the 19 features."""
    return _derived(base_features(pairs, views, strict))


def viewed_features(both: DataFrame) -> DataFrame:
    """The same for pairs that have the views on either side already, as q and c."""
    return _derived(_compared(both))


def _derived(compared: DataFrame) -> DataFrame:
    got = compared.withColumns({k: F.expr(v) for k, v in _DERIVED.items()})
    return got.select("query_id", "candidate_id", *(c for c in ("rank", "label", "split", "pool_size") if c in got.columns), *FEATURES)


def pair_rank(featured: DataFrame, use_address: bool = True) -> DataFrame:
    return featured.withColumn("pair_rank", F.expr(RANK if use_address else RANK_NAME))
