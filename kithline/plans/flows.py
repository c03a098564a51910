"""Whole flows from sources to written results."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithline.functions.constants import FEATURES, MODEL_THRESHOLD, RULE_THRESHOLD
from kithline.operators import audit, evaluate, features, index, keys, model, records, retrieve, rules, sampling
from kithline.operators.boosting import Trees
from kithline.operators.store import kept
from kithline.sources.tsv import Bundle, IncompleteOutput, write_results, write_tsv


def everything(bundle: Bundle) -> DataFrame:
    return bundle.source1.select(records.ENTITY).unionByName(bundle.source2.select(records.ENTITY)).unionByName(bundle.source3.select(records.ENTITY))


def rule_submission(bundle: Bundle, path: str | None = None, threshold: float = RULE_THRESHOLD) -> DataFrame:
    """Block by name words and numbers, score, accept, one row for every record of source 1."""
    views = records.with_views(everything(bundle))
    keyed = keys.rule_keys(views)
    ours = "entity_id like 'S1-%'"
    pairs = rules.candidates(rules.exploded(keyed.where(ours)), rules.rule_postings(keyed))
    out = rules.submission(bundle.source1, rules.accepted(rules.scored(pairs, records.signature(views)), threshold))
    if path:
        write_results(out, bundle.source1, path)
    return out


def candidate_pools(bundle: Bundle, k: int = 300, legacy: bool = False) -> DataFrame:
    """query_id, candidate_id, score, routes, rank, relative_score: the first k of each query over the enhanced keys."""
    rows = keys.exploded(keys.enhanced_keys(records.with_views(everything(bundle))))
    asked = rows.where("entity_id like 'S1-%'")
    postings = index.projected(index.indexed_only(rows), asked)
    scored = retrieve.scores(asked, postings, index.statistics(postings), index.populations(everything(bundle)), legacy)
    return retrieve.relative(retrieve.ranked(scored)).where(F.col("rank") <= k)


def pair_rows(bundle: Bundle, pools: DataFrame, strict: bool = False) -> DataFrame:
    """The 19 features of pooled pairs; views are made once a record."""
    return features.all_features(pools, records.pair_view(records.with_views(everything(bundle))), strict)


def training_rows(bundle: Bundle, pools: DataFrame) -> DataFrame:
    truth = evaluate.long_form(bundle.truth, "matched_entity_ids").select("query_id", F.col("true_id").alias("candidate_id"), F.lit(1).alias("label"))
    return pair_rows(bundle, pools).join(truth, ["query_id", "candidate_id"], "left").na.fill(0, ["label"])


def train(bundle: Bundle, pools: DataFrame, rounds: int = 150, least_oracle: float | None = None) -> Trees:
    """Fits the pair model after the gate on what the pools could reach at best."""
    if least_oracle is not None:
        truth = evaluate.long_form(bundle.truth, "matched_entity_ids")
        best = evaluate.at_k(bundle.source1.select("entity_id", "country"), truth, pools).where("grp = 'all' and k = -1").first()
        model.gate(best["oracle_macro_f05"], least_oracle)
    return model.fit(training_rows(bundle, pools), rounds)


def model_submission(bundle: Bundle, pools: DataFrame, fitted: Trees, path: str | None = None, threshold: float = MODEL_THRESHOLD, candidates_path: str | None = None, strict: bool = False) -> DataFrame:
    """Scores pools, accepts, and writes results for every query; with candidates_path, the pools too."""
    chosen = model.accept(model.predict(fitted, pair_rows(bundle, pools, strict)), threshold)
    out = rules.submission(bundle.source1, chosen)
    if path:
        write_results(out, bundle.source1, path)
    if candidates_path:
        lists = pools.groupBy("query_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(rank, candidate_id))), x -> x.candidate_id), ',')").alias("ids"))
        rows = bundle.source1.select(F.col("entity_id").alias("query_id")).distinct().join(lists, "query_id", "left")
        write_tsv(rows.select(F.col("query_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("candidate_entity_ids")), candidates_path, ["source1_entity_id"])
    return out


def save_pools(pools: DataFrame, path: str) -> None:
    """One row a query: candidates, relative scores and routes in rank order. Refuses to overwrite."""
    retrieve.pools(pools).write.mode("errorifexists").parquet(path)


def load_pools(spark: SparkSession, path: str, k: int = 300) -> DataFrame:
    return retrieve.unpacked(spark.read.parquet(path), k)


class CacheMismatch(ValueError):
    """Stored features are of other columns or other pools."""


def cached_features(bundle: Bundle, pools: DataFrame, path: str) -> DataFrame:
    """The feature rows of pools, from path if they are stored there, else computed and stored.

    Stored rows must have the features in their order, and as many rows for every
    query as its pool.
    """
    spark = pools.sparkSession
    try:
        names = json.loads(spark.read.text(f"{path}/columns").first()["value"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        training_rows(bundle, pools).select("query_id", "candidate_id", "rank", *FEATURES, "label").write.mode("errorifexists").parquet(f"{path}/rows")
        spark.createDataFrame([(json.dumps(FEATURES),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/columns")
        return spark.read.parquet(f"{path}/rows")
    if names != FEATURES:
        raise CacheMismatch("stored features are not the ones in use")
    rows = spark.read.parquet(f"{path}/rows")
    sizes = lambda frame, name: frame.groupBy("query_id").agg(F.count("*").alias(name))
    if not sizes(rows, "a").join(sizes(pools, "b"), "query_id", "full").where("not a <=> b").isEmpty():
        raise CacheMismatch("stored features are not those of these pools")
    return rows


def score_saved_pools(bundle: Bundle, pools: DataFrame, fitted: Trees, path: str, threshold: float = MODEL_THRESHOLD) -> tuple[int, int]:
    """Matches and candidates of stored pools as two files below path; rows of each. Nothing is written if a query would be missing."""
    if not pools.select(F.col("query_id").alias("entity_id")).distinct().join(bundle.source1, "entity_id", "left_anti").isEmpty():
        raise IncompleteOutput("pools have queries that source 1 doesn't have")
    model_submission(bundle, pools, fitted, f"{path}/matching", threshold, f"{path}/candidates")
    spark = pools.sparkSession
    written = tuple(spark.read.csv(f"{path}/{part}", sep="\t", header=True).count() for part in ("matching", "candidates"))
    if written != (n := bundle.source1.select("entity_id").distinct().count(),) * 2:
        raise IncompleteOutput(f"{written} rows were written for {n} queries")
    return written


def materialized(bundle: Bundle, pools: DataFrame, path: str) -> DataFrame:
    """The records of all candidates of pools, stored once; every candidate must have one."""
    wanted = pools.select(F.col("candidate_id").alias("entity_id")).distinct()
    everything(bundle).join(wanted, "entity_id", "left_semi").write.mode("errorifexists").parquet(path)
    got = pools.sparkSession.read.parquet(path)
    if not wanted.join(got, "entity_id", "left_anti").isEmpty():
        raise IncompleteOutput("candidates without a record")
    return got


def split_table(bundle: Bundle, dev: int = 50_000) -> DataFrame:
    """source1_entity_id, country, match_count, bucket, split, dev_sample."""
    n = evaluate.long_form(bundle.truth, "matched_entity_ids").groupBy("query_id").agg(F.countDistinct("true_id").alias("match_count"))
    rows = bundle.source1.join(n, F.col("entity_id") == F.col("query_id"), "left").select(F.col("entity_id").alias("source1_entity_id"), "country", F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"))
    return sampling.dev_sample(sampling.split(rows), dev)


def rerank_report(bundle: Bundle, pools: DataFrame) -> DataFrame:
    """ranking (retrieval, name, name and address), grp (all, countries, sources, names in a native script), k: recall and the F0.5 that could be reached at best."""
    truth = evaluate.long_form(bundle.truth, "matched_entity_ids")
    rows = kept(pair_rows(bundle, pools), "pairs")
    native = bundle.source1.where(audit.native_script("business_name")).select("entity_id", F.lit("native_name").alias("country"))
    out = None
    for name, ranked in (("retrieval", rows.withColumn("pair_rank", -F.col("rank"))), ("name", features.pair_rank(rows, False)), ("name_address", features.pair_rank(rows))):
        order = Window.partitionBy("query_id").orderBy(F.desc("pair_rank"), "rank")
        ranks = kept(ranked.select("query_id", "candidate_id", F.row_number().over(order).alias("rank")), "ranks")
        whole = evaluate.at_k(bundle.source1.select("entity_id", "country"), truth, ranks)
        other = evaluate.at_k(native, truth, ranks).where("grp = 'country:native_name'").withColumn("grp", F.lit("native_name"))
        got = whole.unionByName(other).withColumn("ranking", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


#: Key families by mode of the ablation.
BASE_FAMILIES = ["t", "p", "s", "sk", "c", "n", "ns", "aw"]
MODES = {"baseline": [], "folded": ["f_t", "f_c", "f_aw"], "address_combinations": ["a2", "an", "n2"], "skeleton_fragments": ["sg"]}


def ablation(bundle: Bundle) -> DataFrame:
    """mode, grp, k: recall at k with the families of each mode."""
    rows = kept(keys.exploded(keys.enhanced_keys(records.with_views(everything(bundle)))), "keys")
    asked = rows.where("entity_id like 'S1-%'")
    postings = index.projected(index.indexed_only(rows), asked)
    stats = kept(index.statistics(postings), "statistics")
    truth, out = evaluate.long_form(bundle.truth, "matched_entity_ids"), None
    for mode, more in MODES.items():
        own = asked.where(keys.route(F.col("key")).isin(BASE_FAMILIES + more))
        ranks = retrieve.ranked(retrieve.scores(own, postings, stats, index.populations(everything(bundle)), with_routes=False))
        got = evaluate.at_k(bundle.source1.select("entity_id", "country"), truth, ranks).withColumn("mode", F.lit(mode))
        out = got if out is None else out.unionByName(got)
    return out
