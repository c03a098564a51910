"""All registered queries of the linkage engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.functions import text as T
from kithline.functions.constants import CUTOFFS, FEATURES, INDIC_LETTERS, BASE_FEATURES, RULE_THRESHOLD, SUPPORT_BLOCK, SUPPORT_RANK, SWEEP_THRESHOLDS
from kithline.functions.unicode import forms
from kithline.operators import audit, evaluate, features, index, keys, model, pooled, records, retrieve, rules, sampling, search, validate
from kithline.operators.store import kept, spread
from kithline.plans.oracle import ORACLE_SQL
from kithline.sources import adapters

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Candidates of a query that pair queries work on, and that a route pool holds.
POOL_K, ROUTE_POOL = max(CUTOFFS), 1000


def r6(*names: str):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


class Linkage:
    """The frames that queries over part records share. Views and keys are computed once, when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.records = adapters.parts(spark, sf_dir)
        self._weighted: dict[int, DataFrame] = {}
        self._stats: dict[int, DataFrame] = {}
        self.truth = adapters.part_truth(spark, sf_dir)
        self.queries = self.records.where("entity_id like 'S1-%'").select("entity_id", "country")
        self.population = index.populations(self.records)

    @cached_property
    def views(self) -> DataFrame:
        return kept(records.with_views(spread(self.records, "entity_id")), "views")

    def weighted(self, generation: int) -> DataFrame:
        if generation not in self._weighted:
            views = self.views.repartition("entity_id")  # so that the keys of a record are together, and are not shuffled
            self._weighted[generation] = kept(keys.exploded(keys.weighted_keys(views) if generation == 2 else keys.enhanced_keys(views)), "keys")
        return self._weighted[generation]

    def parts(self, generation: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Query keys, postings of the keys they have, and their statistics."""
        rows = self.weighted(generation)
        asked = rows.where("entity_id like 'S1-%'")
        if generation not in self._stats:
            self._stats[generation] = kept(index.asked_statistics(rows, asked), "stats")
        return asked, index.indexed_only(rows), self._stats[generation]

    def ranks(self, generation: int = 2, legacy: bool = False, k: int | None = None, with_routes: bool = True) -> DataFrame:
        if legacy:
            asked, postings, stats = self.parts(generation)
            return retrieve.ranked(retrieve.scores(asked, index.projected(postings, asked), stats, self.population, legacy, with_routes), k)
        return search.searched(*self.parts(generation), self.population, k, None, with_routes)

    @cached_property
    def true_lists(self) -> DataFrame:
        return kept(adapters.part_truth_lists(self.spark, self.sf_dir), "truth")

    def losses(self) -> DataFrame:
        """The loss report of all true links."""
        stats = self.parts(2)[2]
        views = kept(evaluate.key_view(self.weighted(2), index.usable(stats), self.views.select("entity_id", "country", "scripts", "address")), "key-views")
        return evaluate.link_losses(search.searched(*self.parts(2), self.population, None, self.true_lists, False, views))

    def rule_parts(self) -> tuple[DataFrame, DataFrame]:
        keyed = kept(keys.rule_keys(spread(self.views, "entity_id")).select("entity_id", "country", "keys"), "rule-keys")
        return rules.exploded(keyed.where("entity_id like 'S1-%'")), kept(rules.rule_postings(keyed), "rule-postings")  # a plan holds them several times

    @cached_property
    def rule_scores(self) -> DataFrame:
        return kept(rules.scored(rules.candidates(*self.rule_parts()), records.signature(self.views)), "scores")

    def chosen(self) -> DataFrame:
        return rules.accepted(self.rule_scores, RULE_THRESHOLD)

    @cached_property
    def chosen_lists(self) -> DataFrame:
        return kept(search.listed(self.chosen()), "chosen")

    def per_query(self) -> DataFrame:
        return evaluate.per_query(self.queries, self.true_lists, self.chosen_lists)

    def featured(self, k: int = POOL_K, labelled: bool = False) -> DataFrame:
        """Features of the first k candidates of each query, computed where the query is searched; labelled: with label, 1 for true pairs, and pool_size."""
        found = search.searched(*self.parts(3), self.population, k, None, True, records.packed_view(self.views).select("entity_id", "view"), self.true_lists if labelled else None, unpack=records.unpacked_view())
        return features.viewed_features(found.withColumn("relative_score", F.col("score") / F.greatest(F.lit(1e-9), F.col("best"))))

    def probable(self, k: int = POOL_K) -> DataFrame:
        return model.fixed_score(self.featured(k, True))

    def route_pool(self) -> DataFrame:
        return search.searched(*self.parts(3), self.population, None, None, False, pool=ROUTE_POOL)

    def truth_rows(self) -> DataFrame:
        lists = self.truth.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("true_id")), ",").alias("ids"))
        return self.queries.join(lists, F.col("entity_id") == F.col("query_id"), "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))

    def split(self) -> DataFrame:
        n = self.truth.groupBy("query_id").agg(F.countDistinct("true_id").alias("match_count"))
        rows = self.queries.join(n, F.col("entity_id") == F.col("query_id"), "left").select(F.col("entity_id").alias("source1_entity_id"), "country", F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"))
        return sampling.split(rows)

    def errors(self) -> DataFrame:
        return evaluate.errors(self.per_query(), self.true_lists, self.chosen_lists)

    def report(self, *by: str) -> DataFrame:
        got = evaluate.report(self.per_query(), *by)
        return got.select(*by, "entities", *r6("macro_f05"), "true_pairs", "predicted_pairs", "true_positives", "singletons", "singleton_correct", *r6("pair_precision", "pair_recall", "singleton_accuracy"))

    def at_k(self) -> DataFrame:
        got = evaluate.links_at_k(self.queries, search.searched(*self.parts(2), self.population, None, self.true_lists, False).withColumnRenamed("candidate_id", "true_id"))
        return got.select("grp", "k", "entities", "true_links", "hits", "covered", *r6("pair_recall", "oracle_macro_f05"))

    def sweep(self, thresholds: list[float], cutoffs: list[int] | None = None, k: int = POOL_K) -> DataFrame:
        got = evaluate.threshold_sweep(self.queries, self.true_lists, self.probable(k), thresholds, cutoffs)
        return got.select("cutoff", "threshold", "entities", *r6("macro_f05"), "true_pairs", "predicted_pairs", "true_positives", "singletons", "singleton_correct", *r6("pair_precision", "pair_recall", "singleton_accuracy"))


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(adapters.whole_documents(spark, sf_dir)).withColumn("f", forms(F.col("business_name"), F.lit("")))
    return docs.select("entity_id", F.col("f.name_norm").alias("normalized"), F.col("f.name_folded").alias("folded"), F.col("f.name_core").alias("core"))


def _suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = adapters.table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(c_name, element_at(array(' Inc.', ' Pvt. Ltd.', ' Limited Company', '', ' S.A. SA'), cast(1 + c_custkey % 5 as int))) as n")
    return names.withColumn("f", forms(F.col("n"), F.lit(""))).select("c_custkey", F.expr(T.without_legal_suffixes("f.name_norm")).alias("core"))


def _indic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skeletons of names with a run of Indic letters, a different one for each customer."""
    n, letters = len(INDIC_LETTERS), INDIC_LETTERS
    names = adapters.table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat(substring('{letters}', cast(1 + c_custkey % {n} as int), 4), ' Chx ', substring('{letters}', cast(1 + (7 * c_custkey) % {n} as int), 3), '\u0c81\u0c31\u0cb1') as n")
    return names.select("c_custkey", F.expr(T.consonant_skeleton("lower(n)")).alias("skeleton"))


def _skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(adapters.whole_documents(spark, sf_dir)).withColumn("f", forms(F.col("business_name"), F.lit("")))
    return docs.select("entity_id", F.expr(T.consonant_skeleton("f.name_folded")).alias("skeleton"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = adapters.parts(spark, sf_dir), None
    for s in ("S1", "S2", "S3"):
        got = audit.profile(rows.where(f"entity_id like '{s}-%'"), s).select(F.lit(s).alias("source"), "*")
        out = got if out is None else out.unionByName(got)
    return out


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = Linkage(spark, sf_dir)
    asked, postings, stats = link.parts(3)
    base = ["t", "p", "s", "sk", "c", "n", "ns", "aw"]
    modes = {"baseline": [], "folded": ["f_t", "f_c", "f_aw"], "address_combinations": ["a2", "an", "n2"], "skeleton_fragments": ["sg"]}
    found = search.totals(asked, postings, stats, link.population, {mode: base + more for mode, more in modes.items()})
    sums = found.groupBy("mode").agg(F.sum("pairs").alias("pairs"), F.round(F.sum("total").cast("double") / F.lit(1e12), 6).alias("total_score"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    return names.join(sums, "mode", "left").select("mode", F.coalesce("pairs", F.lit(0)).alias("pairs"), "total_score")


def _country_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries of source 1 of the customers against those of source 2."""
    rows = adapters.customers(spark, sf_dir)
    return audit.country_compare(rows.where("entity_id like 'S1-%'"), rows.where("entity_id like 'S2-%'"))


def _submission_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about a deliberately broken result table: every third row is missing, one id is unknown."""
    link = Linkage(spark, sf_dir)
    rows = rules.submission(link.queries, link.chosen()).where("not source1_entity_id like '%3'")
    lines = rows.select(F.lit(True).alias("tab"), F.col("source1_entity_id").alias("s1"), F.expr("if(matched_entity_ids = '', array('S1-1', 'X9', 'S2-1', 'S2-1'), split(matched_entity_ids, ','))").alias("ids"), F.lit("").alias("value"))
    return validate.content_findings(lines, link.queries.select(F.col("entity_id").alias("s1")), link.records.select(F.col("entity_id").alias("id")))


def _pool_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = Linkage(spark, sf_dir)
    sizes = link.ranks(with_routes=False).groupBy(F.col("query_id").alias("entity_id")).agg(F.count("*").alias("n"))
    return evaluate.distribution(link.queries.join(sizes, "entity_id", "left").select(F.coalesce("n", F.lit(0)).cast("bigint").alias("v")), "v")


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Linkage(spark, sf_dir).losses().groupBy("reason").agg(F.count("*").alias("links"))


def _subset(spark: SparkSession, sf_dir: str, k: int = POOL_K) -> DataFrame:
    link = Linkage(spark, sf_dir)
    found = search.searched(*link.parts(2), link.population, None, link.chosen_lists, False)  # each match once, with a null rank if it's in no pool
    return found.agg(F.count("*").alias("matches"), F.expr(f"count_if(coalesce(rank > {k}, true))").alias("outside"))


def _block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = Linkage(spark, sf_dir)
    support = kept(rules.supported(*link.rule_parts(), SUPPORT_BLOCK), "support")
    ruled = rules.block_rules(support, rules.near_names(support, link.views))
    return evaluate.rule_report(link.queries, link.truth, ruled, ["overlap", "two-supports", "top3", "top1", "name-top3"])


def _rule_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = Linkage(spark, sf_dir)
    names = [f"{t:.2f}" for t in SWEEP_THRESHOLDS] + ["top1>=0.60", "top3>=0.45"]
    return evaluate.rule_report(link.queries, link.truth, rules.sweep_rules(link.rule_scores), names).select("rule", *r6("macro_f05"))


def _pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = Linkage(spark, sf_dir)
    ones = link.views.where("entity_id like 'S1-%'")
    return sampling.select_pilot(ones, link.truth, max(1, link.queries.count() // 10)).select("entity_id", "country", "bucket", "scripts", "common")


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosted model over whole pools: trained on the train side of the stratified split, scored on all queries."""
    link = Linkage(spark, sf_dir)
    named, lists = adapters.part_truth_shared(spark, sf_dir)
    rows = kept(pooled.pools(link.records, link.population, named, kept(lists, "truth"), POOL_K), "pools")
    return pooled.predict(model.fit(rows.where("split = 'train'")), rows)


def _truth_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = Linkage(spark, sf_dir)
    return audit.truth_anomalies(link.truth_rows(), *(link.records.where(f"entity_id like 'S{s}-%'") for s in (1, 2, 3)))


def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that source 2 alone doesn't have."""
    link = Linkage(spark, sf_dir)
    there = link.records.where("entity_id like 'S2-%'").select(F.col("entity_id").alias("true_id"))
    return link.truth.distinct().join(there, "true_id", "left_anti").select("query_id", "true_id")


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["country", "bucket"]
    groups = kept(sampling.strata(Linkage(spark, sf_dir).split(), by), "strata")
    total = groups.agg(F.sum("available").alias("n"), F.count("*").alias("k")).first()
    size = max(1, total["n"] // 5)
    pilot = sampling.allocated(groups, by, max(size, total["k"]), 1).withColumnRenamed("quota", "pilot")
    return pilot.join(sampling.allocated(groups, by, size).select(*by, F.col("quota").alias("members")), by).select(*by, "available", F.col("pilot").cast("bigint"), F.col("members").cast("bigint"))


def _loss_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Linkage(spark, sf_dir).losses()
    return rows.select(*(F.round("retrieval_score", 6).alias(c) if c == "retrieval_score" else F.col(c) for c in rows.columns))


def _posting_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = Linkage(spark, sf_dir)
    asked, _, stats = link.parts(2)
    return evaluate.posting_sizes(asked, stats)


def _on(name: str, *args, then: Callable[[DataFrame], DataFrame] = lambda d: d):
    """A query that calls a method of Linkage."""
    return lambda spark, sf_dir: then(getattr(Linkage(spark, sf_dir), name)(*args))


def _ranked(*more: str):
    return lambda d: d.where("rank <= 20").select("query_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"), *r6("score"), *([F.array_join("routes", ",").alias("routes")] if "routes" in more else []))


_sorted = lambda c, name: F.array_join(F.array_sort(c), " ").alias(name)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_profile": _profile,
    "normalize_name": _normalize,
    "legal_suffix_core": _suffixes,
    "consonant_skeleton": _skeleton,
    "address_parts": lambda s, d: Linkage(s, d).views.select("entity_id", _sorted("address_words", "words"), _sorted("address_numbers", "numbers")),
    "char_grams": lambda s, d: records.pair_view(Linkage(s, d).views).select("entity_id", _sorted("view.name_grams", "grams"), F.size("view.name_grams").cast("bigint").alias("n")),
    "keys_g1": lambda s, d: rules.exploded(keys.rule_keys(Linkage(s, d).views)),
    "keys_g2": _on("weighted", 2, then=lambda k: k.select("entity_id", "country", "key", *r6("weight"), "mult")),
    "keys_g3": _on("weighted", 3, then=lambda k: k.select("entity_id", "country", "key", *r6("weight"), "mult")),
    "doc_freq": _on("weighted", 2, then=lambda k: index.statistics(index.indexed_only(k)).select("country", "key", "df")),
    "term_freq": _on("weighted", 2, then=lambda k: index.statistics(index.indexed_only(k)).select("country", "key", "tf")),
    "usable_keys": _on("weighted", 2, then=lambda k: index.usable(index.statistics(index.indexed_only(k))).select("country", "key", "df", "tf", F.col("cap").cast("bigint").alias("cap"))),
    "retrieve_topk_dedup": _on("ranks", 2, False, 20, then=_ranked()),
    "retrieve_topk_legacy": _on("ranks", 2, True, 20, then=_ranked()),
    "retrieve_topk_enhanced": _on("ranks", 3, False, 20, then=_ranked("routes")),
    "block_token_number": _on("rule_parts", then=lambda p: rules.supported(*p, SUPPORT_RANK)),
    "rare_token_route": _on("rule_parts", then=lambda p: rules.rare(*p)),
    "pair_score_rule": lambda s, d: Linkage(s, d).rule_scores.select("query_id", "candidate_id", *r6("score")),
    "rule_submission": lambda s, d: rules.submission(Linkage(s, d).queries, Linkage(s, d).chosen()),
    "block_rules": _block_rules,
    "rule_sweep": _rule_sweep,
    "pair_features_base": _on("featured", then=lambda f: f.select("query_id", "candidate_id", *r6(*BASE_FEATURES))),
    "pair_features_all19": _on("featured", then=lambda f: f.select("query_id", "candidate_id", *r6(*FEATURES))),
    "pair_rank_name": _on("featured", then=lambda f: features.pair_rank(f, False).select("query_id", "candidate_id", *r6("pair_rank"))),
    "pair_rank_name_address": _on("featured", then=lambda f: features.pair_rank(f).select("query_id", "candidate_id", *r6("pair_rank"))),
    "route_pool": _on("route_pool", then=lambda r: r.select("query_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"))),
    "recall_at_k": _on("at_k", then=lambda a: a.select("grp", "k", "true_links", "hits", "pair_recall")),
    "oracle_f05_at_k": _on("at_k", then=lambda a: a.where("entities > 0").select("grp", "k", "entities", "covered", "oracle_macro_f05")),
    "loss_reasons": _losses,
    "pool_distribution": _pool_distribution,
    "macro_f05": _on("report"),
    "pair_precision_recall": _on("report", then=lambda r: r.select("true_pairs", "predicted_pairs", "true_positives", "pair_precision", "pair_recall")),
    "singleton_accuracy": _on("report", then=lambda r: r.select("singletons", "singleton_correct", "singleton_accuracy")),
    "country_f05": _on("report", "country", then=lambda r: r.select("country", "entities", "macro_f05")),
    "threshold_sweep": _on("sweep", [round(0.05 + 0.025 * i, 3) for i in range(37)]),
    "cutoff_sweep": _on("sweep", [0.6], CUTOFFS),
    "stratified_split": _on("split", then=lambda s: s.select("source1_entity_id", "country", "match_count", "bucket", "split")),
    "split_summary": _on("split", then=sampling.summary),
    "dev_sample": _on("split", then=lambda s: sampling.dev_sample(s, 50)),
    "quota_allocation": _quota,
    "select_pilot": _pilot,
    "dup_ids": lambda s, d: audit.duplicates(adapters.table(s, d, "part").selectExpr("concat('P-', p_name) as entity_id")),
    "dangling_refs": _dangling,
    "truth_anomalies": _truth_anomalies,
    "submission_validation": _submission_findings,
    "matches_subset_candidates": _subset,
    "family_overlap": lambda s, d: audit.family_overlap(Linkage(s, d).truth, Linkage(s, d).weighted(3)),
    "ablation_families": _ablation,
    "country_compare": _country_compare,
    "cartesian_sizes": lambda s, d: audit.cartesian(adapters.parts(s, d)),
    "confirmation_errors": _on("errors", then=lambda e: e.select("query_id", *r6("f05"), "true_n", "predicted_n", "false_positive_ids", "false_negative_ids")),
    "pair_model": _model,
    "indic_skeleton": _indic,
    "loss_table": _loss_table,
    "posting_sizes": _posting_sizes,
    "block_rules_by_support": lambda s, d: _block_rules(s, d).where("rule <> 'name-top3'").select("rule", *r6("macro_f05", "singleton_accuracy")),
}
