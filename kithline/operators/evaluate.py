"""Metrics. Every report starts from the query frame, so queries without candidates or truth count.

truth: query_id, true_id (long form). chosen: query_id, candidate_id. Conventions for
empty denominators differ by report and are kept: see each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.constants import RECALL_KS, SHORTLIST
from kithline.operators.search import listed


class EvaluationInputError(ValueError):
    """Predictions or countries don't fit the truth."""


# Fixed value: what the id of a match looks like.
ID = "^S[23]-[A-Za-z0-9][A-Za-z0-9._:-]*$"


def long_form(frame: DataFrame, ids: str, query: str = "source1_entity_id", name: str = "true_id") -> DataFrame:
    """query_id and one id a row of a comma list column."""
    return frame.select(F.col(query).alias("query_id"), F.explode(F.expr(T.id_list(ids))).alias(name))


def checked_ids(frame: DataFrame, ids: str = "matched_entity_ids") -> None:
    """Raises for malformed ids, and for ids that come twice in a list."""
    parts = frame.select(F.expr(f"filter(transform(split(coalesce({ids}, ''), ','), x -> trim(x)), x -> coalesce({ids}, '') <> '')").alias("p"))
    bad = parts.agg(F.max(F.expr(f"exists(p, x -> not x rlike '{ID}')")).alias("malformed"), F.max(F.expr("size(p) <> size(array_distinct(p))")).alias("twice")).first()
    if bad["malformed"]:
        raise EvaluationInputError("Malformed match IDs")
    if bad["twice"]:
        raise EvaluationInputError("Duplicate IDs in a match list")


def per_query(queries: DataFrame, truth: DataFrame, chosen: DataFrame) -> DataFrame:
    """query_id, country, true_n, predicted_n, tp, f05. truth and chosen may be lists (query_id, ids)."""
    t, p = listed(truth, "true_id").select("query_id", F.col("ids").alias("t")), listed(chosen).select("query_id", F.col("ids").alias("p"))
    size = lambda a: F.expr(f"cast(size(coalesce({a}, {T.EMPTY})) as bigint)")
    counts = t.join(p, "query_id", "full").select("query_id", size("t").alias("true_n"), size("p").alias("predicted_n"), size("array_intersect(t, p)").alias("tp"))
    return queries.select(F.col("entity_id").alias("query_id"), "country").join(counts, "query_id", "left").na.fill(0, ["true_n", "predicted_n", "tp"]).withColumn("f05", F.expr(T.f05("tp", "predicted_n", "true_n")))


def _ratio(a: str, b: str, empty: str) -> str:
    return f"if({b} = 0, {empty}, {a} / cast({b} as double))"


MACRO = {
    "entities": "count(*)", "macro_f05": "coalesce(avg(f05), 0.0D)", "true_pairs": "coalesce(sum(true_n), 0)", "predicted_pairs": "coalesce(sum(predicted_n), 0)", "true_positives": "coalesce(sum(tp), 0)",
    "singletons": "count_if(true_n = 0)", "singleton_correct": "count_if(true_n = 0 and predicted_n = 0)",
}


def report(scored: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5, pair precision and recall, singleton accuracy.

    Nothing predicted: precision 1 if nothing is true, else 0; nothing true: recall 1
    if nothing is predicted, else 0; no singletons: accuracy is null.
    """
    got = scored.groupBy(*by).agg(*(F.expr(v).alias(k) for k, v in MACRO.items()))
    return got.withColumns({
        "pair_precision": F.expr(_ratio("true_positives", "predicted_pairs", "if(true_pairs = 0, 1.0D, 0.0D)")), "pair_recall": F.expr(_ratio("true_positives", "true_pairs", "if(predicted_pairs = 0, 1.0D, 0.0D)")),
        "singleton_accuracy": F.expr(_ratio("singleton_correct", "singletons", "null")),
    })


def evaluated(queries: DataFrame, truth: DataFrame, chosen: DataFrame) -> DataFrame:
    """The report over all queries; predictions for unknown queries raise."""
    known = queries.select(F.col("entity_id").alias("query_id"))
    if not chosen.select("query_id").distinct().join(known, "query_id", "left_anti").isEmpty():
        raise EvaluationInputError("Predictions contain Source 1 IDs absent from ground truth")
    return report(per_query(queries, truth, chosen))


def rule_report(queries: DataFrame, truth: DataFrame, ruled: DataFrame, rules: list[str]) -> DataFrame:
    """rule, macro_f05, singleton_accuracy (0 without singletons) for chosen pairs by rule; a rule without pairs counts too."""
    base = queries.select(F.col("entity_id").alias("query_id"), F.posexplode(F.array(*map(F.lit, rules))).alias("place", "rule"))
    t = truth.select("query_id", F.col("true_id").alias("candidate_id"), F.lit(1).alias("t")).distinct()
    true_n = t.groupBy("query_id").agg(F.count("*").alias("true_n"))
    hits = ruled.distinct().join(t, ["query_id", "candidate_id"], "left").groupBy("rule", "query_id").agg(F.count("*").alias("predicted_n"), F.count("t").alias("tp"))
    rows = base.join(true_n, "query_id", "left").join(hits, ["rule", "query_id"], "left").na.fill(0, ["true_n", "predicted_n", "tp"]).withColumn("f05", F.expr(T.f05("tp", "predicted_n", "true_n")))
    return rows.groupBy("place", "rule").agg(F.avg("f05").alias("macro_f05"), F.expr("coalesce(avg(if(true_n = 0, if(predicted_n = 0, 1.0D, 0.0D), null)), 0.0D)").alias("singleton_accuracy"))


def best_rule(reported: DataFrame) -> DataFrame:
    """The rule with the highest macro F0.5; the first of equals."""
    return reported.orderBy(F.desc("macro_f05"), "place").limit(1)


def at_k(queries: DataFrame, truth: DataFrame, ranks: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """grp, k, entities, true_links, hits, covered, pair_recall, oracle_macro_f05.

    Groups: all, country, source, country and source; the last two have links only,
    so their oracle is null. k -1 stands for the whole pool. No links: recall is null.
    """
    links = truth.distinct().join(ranks.select("query_id", F.col("candidate_id").alias("true_id"), "rank"), ["query_id", "true_id"], "left")
    return links_at_k(queries, links, ks)


def links_at_k(queries: DataFrame, links: DataFrame, ks: list[int] | None = None) -> DataFrame:
    """The same from true links, each once, with the rank that their pool gives them (query_id, true_id, rank or null). Links are counted by query before anything is joined."""
    cuts = [*(ks or RECALL_KS), -1]
    cut = F.explode(F.array(*map(F.lit, cuts)))
    hit = lambda k: F.expr("count(rank)" if k == -1 else f"count_if(rank <= {k})")
    counted = links.groupBy("query_id", F.substring("true_id", 1, 2).alias("source")).agg(F.count("*").alias("true_n"), F.array(*map(hit, cuts)).alias("found"))
    known = counted.join(queries.select(F.col("entity_id").alias("query_id"), "country"), "query_id")
    by_source = known.select("query_id", "country", "source", "true_n", F.posexplode("found").alias("place", "hits")).withColumn("k", F.element_at(F.array(*map(F.lit, cuts)), F.col("place") + 1))
    counts = by_source.groupBy("query_id", "k").agg(F.sum("true_n").alias("true_n"), F.sum("hits").alias("hits"))
    entities = queries.select(F.col("entity_id").alias("query_id"), "country", cut.alias("k")).join(counts, ["query_id", "k"], "left").na.fill(0, ["true_n", "hits"])
    entities = entities.withColumn("oracle", F.expr(T.f05("hits", "hits", "true_n")))
    def whole(name: str):
        return entities.groupBy(F.expr(name).alias("grp"), "k").agg(
            F.count("*").alias("entities"), F.sum("true_n").alias("true_links"), F.sum("hits").alias("hits"), F.expr("count_if(hits > 0)").alias("covered"), F.avg("oracle").alias("oracle_macro_f05")
        )
    def part(name: str):
        return by_source.groupBy(F.expr(name).alias("grp"), "k").agg(
            F.lit(0).cast("bigint").alias("entities"), F.sum("true_n").alias("true_links"), F.sum("hits").alias("hits"), F.lit(0).cast("bigint").alias("covered"), F.lit(None).cast("double").alias("oracle_macro_f05")
        )
    out = whole("'all'").unionByName(whole("concat('country:', country)")).unionByName(part("concat('source:', source)"))
    out = out.unionByName(part("concat('country_source:', country, ':', source)"))
    return out.withColumn("pair_recall", F.expr(_ratio("hits", "true_links", "null")))


NO_KEY, PRUNED, IN_TOP, BELOW = "NO_RAW_KEY", "ALL_SHARED_KEYS_PRUNED", "IN_TOP_K", "RANKED_BELOW_K"


def losses(truth: DataFrame, keys: DataFrame, usable_keys: DataFrame, ranks: DataFrame, k: int = 100) -> DataFrame:
    """A row for each true link: shared families, usable ones, rank, score and the reason it is in the pool or not.

    keys: entity_id, country, key of all records. Sharing ignores the country,
    usable sharing needs it to be the same. ranks are of whole pools: a link with a
    usable shared key and no rank makes the query fail.
    """
    q = keys.select(F.col("entity_id").alias("query_id"), F.col("country").alias("q_country"), "key")
    c = keys.select(F.col("entity_id").alias("true_id"), F.col("country").alias("c_country"), "key")
    family = F.substring_index("key", ":", 1)
    shared = truth.distinct().join(q, "query_id").join(c, ["true_id", "key"]).join(usable_keys.select(F.col("country").alias("q_country"), "key", F.lit(True).alias("ok")), ["q_country", "key"], "left")
    ok = F.expr("coalesce(ok, false) and q_country = c_country")
    seen = shared.groupBy("query_id", "true_id").agg(
        F.concat_ws(",", F.sort_array(F.collect_set(family))).alias("shared_raw_families"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(ok, family)))).alias("shared_usable_families")
    )
    out = truth.distinct().join(seen, ["query_id", "true_id"], "left").join(ranks.select("query_id", F.col("candidate_id").alias("true_id"), "rank", "score"), ["query_id", "true_id"], "left")
    return out.na.fill("", ["shared_raw_families", "shared_usable_families"]).withColumn("reason", F.expr(_reason(k)))


def _reason(k: int) -> str:
    return f"case when shared_raw_families = '' then '{NO_KEY}' when shared_usable_families = '' then '{PRUNED}' when rank is null then raise_error('A link with a usable shared key has no rank') when rank <= {k} then '{IN_TOP}' else '{BELOW}' end"


def key_view(keys: DataFrame, usable_keys: DataFrame, records: DataFrame) -> DataFrame:
    """entity_id and what ``link_losses`` needs of a record as one struct ``view``: its keys, those of them that are usable in its country, and its text columns. records: entity_id, country, scripts, address."""
    rows = keys.select("entity_id", "country", "key").distinct().join(usable_keys.select("country", "key", F.lit(True).alias("ok")), ["country", "key"], "left")
    lists = rows.groupBy("entity_id").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("ok"), F.struct("country", "key"))).alias("usable"))
    view = F.struct("country", "scripts", F.expr("trim(address) = ''").alias("no_address"), F.coalesce("keys", F.expr(T.EMPTY)).alias("keys"), F.expr("coalesce(usable, cast(array() as array<struct<country: string, key: string>>))").alias("usable"))
    return records.join(lists, "entity_id", "left").select("entity_id", view.alias("view"))


def link_losses(links: DataFrame, k: int = 100) -> DataFrame:
    """``losses`` and ``loss_table`` of links that have both records' key views as q and c, and rank, score and wanted from the search: nothing is joined or shuffled."""
    families = lambda x, key: f"array_join(array_sort(array_distinct(transform({x}, x -> substring_index({key}, ':', 1)))), ',')"
    got = links.withColumn("shared_raw_families", F.expr(families("array_intersect(q.keys, c.keys)", "x"))).withColumn("shared_usable_families", F.expr(families("array_intersect(q.usable, c.usable)", "x.key")))
    return got.select(
        F.col("query_id").alias("source1_id"), F.col("candidate_id").alias("true_candidate_id"), F.col("q.country").alias("country"), F.substring("candidate_id", 1, 2).alias("candidate_source"), "shared_raw_families",
        "shared_usable_families", F.expr(_reason(k)).alias("reason"), F.col("rank").cast("bigint").alias("rank_if_ranked"), F.col("score").cast("double").alias("retrieval_score"), F.col("wanted").cast("bigint").alias("number_of_true_siblings"),
        F.expr("if(q.scripts <> c.scripts, 1, 0)").alias("script_mismatch"), F.expr("if(q.no_address or c.no_address, 1, 0)").alias("missing_address"),
    )


def loss_table(found: DataFrame, truth: DataFrame, views: DataFrame) -> DataFrame:
    """The twelve columns of the loss report: losses with the records on either side. views: entity_id, country, scripts, address."""
    siblings = truth.distinct().groupBy("query_id").agg(F.count("*").alias("number_of_true_siblings"))
    side = lambda id_, p: views.select(F.col("entity_id").alias(id_), *(F.col(c).alias(p + c) for c in ("country", "scripts", "address")))
    rows = found.join(siblings, "query_id").join(side("query_id", "q_"), "query_id").join(side("true_id", "t_"), "true_id")
    return rows.select(
        F.col("query_id").alias("source1_id"), F.col("true_id").alias("true_candidate_id"), F.col("q_country").alias("country"), F.substring("true_id", 1, 2).alias("candidate_source"), "shared_raw_families",
        "shared_usable_families", "reason", F.col("rank").cast("bigint").alias("rank_if_ranked"), F.col("score").cast("double").alias("retrieval_score"), "number_of_true_siblings",
        F.expr("if(q_scripts <> t_scripts, 1, 0)").alias("script_mismatch"), F.expr("if(trim(q_address) = '' or trim(t_address) = '', 1, 0)").alias("missing_address"),
    )


def posting_sizes(query_keys: DataFrame, stats: DataFrame, legacy: bool = False) -> DataFrame:
    """family and the distribution of posting sizes over all keys of all queries; a key that nothing has counts 0."""
    size = "tf" if legacy else "df"
    rows = query_keys.select("country", "key").join(stats.select("country", "key", F.col(size).alias("v")), ["country", "key"], "left")
    return distribution(rows.select(F.substring_index("key", ":", 1).alias("family"), F.coalesce("v", F.lit(0)).cast("bigint").alias("v")), "v", "family")


def distribution(values: DataFrame, value: str, *by: str) -> DataFrame:
    """count, p50, p90, p99, max: the values at places floor((n - 1) q) of the sorted ones; all 0 over nothing."""
    order = Window.partitionBy(*by).orderBy(value) if by else Window.partitionBy(F.lit(0)).orderBy(value)
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # equal values are counted first, so the window is over distinct values
    grouped = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = grouped.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(every))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q), F.col(value)))
    out = placed.groupBy(*by).agg(F.max("total").alias("count"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max(value).alias("max"))
    return out if by else out.na.fill(0)


def plain_quantiles(values: DataFrame, value: str) -> DataFrame:
    """count, median and p90: the values at places floor(n / 2) and floor(0.9 n), the last at most; 0 over nothing."""
    every = Window.partitionBy(F.lit(0))
    grouped = values.groupBy(F.col(value).alias("kith_v")).agg(F.count("*").alias("n"))
    placed = grouped.withColumn("upto", F.sum("n").over(every.orderBy("kith_v"))).withColumn("total", F.sum("n").over(every))
    at = lambda place: F.min(F.when(F.col("upto") > F.least(F.floor(place), F.col("total") - 1), F.col("kith_v")))
    return placed.agg(F.coalesce(F.max("total"), F.lit(0)).alias("count"), at(F.col("total") / 2).alias("median"), at(F.col("total") * 0.9).alias("p90")).na.fill(0)


def block_report(queries: DataFrame, truth: DataFrame, shared: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """true_links, found (recall of all that share a key), shortlisted (of the ``most`` with the most shared keys), and the median pool. shared: query_id, candidate_id, shared."""
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), "candidate_id")
    place = shared.withColumn("place", F.row_number().over(order))
    links = truth.distinct().join(place.select("query_id", F.col("candidate_id").alias("true_id"), "place"), ["query_id", "true_id"], "left")
    got = links.agg(F.count("*").alias("true_links"), F.count("place").alias("found"), F.expr(f"count_if(place <= {most})").alias("shortlisted"))
    sizes = shared.groupBy("query_id").agg(F.count("*").alias("n"))
    pools = queries.select(F.col("entity_id").alias("query_id")).join(sizes, "query_id", "left").na.fill(0, ["n"])
    out = got.crossJoin(plain_quantiles(pools, "n").select(F.col("count").alias("queries"), F.col("median").alias("median_pool")))  # one row each
    return out.withColumns({"recall": F.expr(_ratio("found", "true_links", "0.0D")), "shortlist_recall": F.expr(_ratio("shortlisted", "true_links", "0.0D"))})


def threshold_sweep(queries: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: list[float], cutoffs: list[int] | None = None) -> DataFrame:
    """cutoff, threshold, entities, macro_f05, pair_precision, pair_recall, singleton_accuracy and more, for every combination.

    scored: query_id, candidate_id, probability, rank, and label (1 for true pairs) if
    it is known. A pair counts once for all thresholds below it and all cut-offs from
    its rank on: pairs are counted by query and place in the grid, and summed there.
    truth may be lists (query_id, ids).
    """
    cuts, steps = sorted(set(cutoffs or [1 << 30])), sorted({float(t) for t in thresholds})
    grid = F.inline(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.lit(t).alias("threshold"), F.lit(cuts.index(c)).alias("cut"), F.lit(steps.index(t)).alias("step")) for c in (cutoffs or [1 << 30]) for t in map(float, thresholds))))
    lists = listed(truth, "true_id")
    if "label" not in scored.columns:
        pairs = lists.select("query_id", F.explode("ids").alias("candidate_id"), F.lit(1).alias("label"))
        scored = scored.join(pairs, ["query_id", "candidate_id"], "left")
    place = F.expr(f"size(filter(array({', '.join(map(str, cuts))}), x -> rank > x))").alias("cut")
    reached = F.expr(f"transform(array(probability), p -> size(filter(array({', '.join(f'{t!r}D' for t in steps)}), x -> p >= x)))[0]").alias("steps")  # bound to p, or it is computed for each threshold
    placed = scored.select("query_id", place, reached, F.expr("label = 1").alias("label")).where(F.col("cut") < len(cuts))
    counts = placed.groupBy("query_id", "cut", "steps").agg(F.count("*").alias("n"), F.expr("count_if(label)").alias("tp")).groupBy("query_id").agg(F.collect_list(F.struct("cut", "steps", "n", "tp")).alias("counts"))
    of = lambda condition, n: F.expr(f"aggregate(filter(coalesce(counts, array()), x -> {condition}), 0L, (s, x) -> s + x.{n})")
    true_n = lists.select("query_id", F.expr("cast(size(ids) as bigint)").alias("true_n"))
    rows = queries.select(F.col("entity_id").alias("query_id"), "country").join(true_n, "query_id", "left").join(counts, "query_id", "left").na.fill(0, ["true_n"]).select("*", grid)
    rows = rows.withColumns({"predicted_n": of("x.cut <= cut and x.steps > step", "n"), "tp": of("x.cut <= cut and x.steps > step", "tp"), "available": of("x.cut <= cut", "tp")}).drop("counts", "cut", "step")
    rows = rows.withColumn("f05", F.expr(T.f05("tp", "predicted_n", "true_n"))).withColumn("oracle", F.expr(T.f05("available", "available", "true_n")))
    base = report(rows, "cutoff", "threshold")
    more = rows.groupBy("cutoff", "threshold").agg(
        F.avg("oracle").alias("oracle_macro_f05"), F.expr("avg(if(true_n > 0, if(tp = true_n, 1.0D, 0.0D), null))").alias("all_match_completeness"), F.expr("avg(if(predicted_n = 0, 1.0D, 0.0D))").alias("predicted_empty_rate"),
        F.avg("predicted_n").alias("mean_predicted_matches"), F.avg("true_n").alias("mean_true_matches"),
    )
    return base.join(more, ["cutoff", "threshold"])


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The best threshold; the higher of equals."""
    return sweep.orderBy(F.desc("macro_f05"), F.desc("threshold")).limit(1)


def errors(scored: DataFrame, truth: DataFrame, chosen: DataFrame) -> DataFrame:
    """Queries with F0.5 below 1: counts, false positive and false negative ids. truth and chosen may be lists (query_id, ids)."""
    t, p = listed(truth, "true_id").select("query_id", F.col("ids").alias("t")), listed(chosen).select("query_id", F.col("ids").alias("p"))
    ids = lambda a, b: F.expr(f"array_join(array_sort(array_except(coalesce({a}, {T.EMPTY}), coalesce({b}, {T.EMPTY}))), ',')")
    return scored.where("f05 < 1").join(t, "query_id", "left").join(p, "query_id", "left").select(
        "query_id", "f05", "true_n", "predicted_n", ids("p", "t").alias("false_positive_ids"), ids("t", "p").alias("false_negative_ids")
    )


def flag_groups(scored: DataFrame, flags: DataFrame) -> DataFrame:
    """flag, value, entities, macro_f05, pair_precision, pair_recall (0 for empty denominators). flags: query_id and boolean columns; missing is false."""
    names = [c for c in flags.columns if c != "query_id"]
    anyway = flags.groupBy("query_id").agg(*(F.bool_or(c).alias(c) for c in names))
    rows = scored.join(anyway, "query_id", "left").na.fill(False, names)
    tall = rows.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("flag"), F.col(n).alias("value")) for n in names))).alias("fl"))
    return tall.groupBy("fl.flag", "fl.value").agg(F.count("*").alias("entities"), F.avg("f05").alias("macro_f05"), F.sum("tp").alias("tp"), F.sum("predicted_n").alias("predicted"), F.sum("true_n").alias("true")).select(
        "flag", "value", "entities", "macro_f05", F.expr(_ratio("tp", "predicted", "0.0D")).alias("pair_precision"), F.expr(_ratio("tp", "true", "0.0D")).alias("pair_recall")
    )


def audit_score(scored: DataFrame, expected: float, within: float = 1e-10) -> float:
    """The macro F0.5 again, from written rows; raises if it isn't the expected one."""
    got = scored.agg(F.coalesce(F.avg("f05"), F.lit(0.0)).alias("m")).first()["m"]
    if abs(got - expected) > within:
        raise EvaluationInputError("Written prediction score differs from the evaluation")
    return got
