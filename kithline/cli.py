"""Command lines: python -m kithline.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.functions.constants import CUTOFFS, MODEL_THRESHOLD, ORACLE_GATE, RULE_THRESHOLD, SEED
from kithline.operators import audit, boosting, evaluate, index, keys, model, records, retrieve, rules, sampling, validate
from kithline.operators.store import kept
from kithline.plans import flows
from kithline.sources import tsv


def _show(frame: DataFrame) -> None:
    """A metric frame as JSON lines."""
    for row in frame.collect():
        print(json.dumps(row.asDict(recursive=True), default=float, ensure_ascii=False))


def _bundle(spark: SparkSession, args: argparse.Namespace) -> tsv.Bundle:
    return tsv.load_bundle(spark, args.source1, args.source2, args.source3, getattr(args, "truth", None))


def _truth(bundle: tsv.Bundle) -> DataFrame:
    return evaluate.long_form(bundle.truth, "matched_entity_ids")


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    truth, found = tsv.load_truth(spark, args.truth), tsv.load_truth(spark, args.predictions)
    evaluate.checked_ids(truth), evaluate.checked_ids(found)
    countries = tsv.load_entities(spark, args.source1).select("entity_id", "country") if args.source1 else truth.select(F.col("source1_entity_id").alias("entity_id"), F.lit("").alias("country"))
    queries = countries.join(truth.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_semi")
    chosen = evaluate.long_form(found, "matched_entity_ids", name="candidate_id")
    long = evaluate.long_form(truth, "matched_entity_ids")
    _show(evaluate.evaluated(queries, long, chosen))
    if args.source1:
        _show(evaluate.report(evaluate.per_query(queries, long, chosen), "country"))
    return 0


def _validate(spark: SparkSession, args: argparse.Namespace) -> int:
    targets = None
    if args.check_ids:
        targets = tsv.load_entities(spark, args.check_ids[0]).select(F.col("entity_id").alias("id"))
        for more in args.check_ids[1:]:
            targets = targets.unionByName(tsv.load_entities(spark, more).select(F.col("entity_id").alias("id")))
    required = tsv.load_entities(spark, args.source1).select(F.col("entity_id").alias("s1"))
    found = validate.validate(spark, args.matching, required, args.candidates, targets)
    for severity, rule, n, shown in found:
        print(f"{severity.upper()}: {rule}: {n} total, e.g. {shown}")
    print("PASS" if validate.passes(found) else "FAIL")
    return int(not validate.passes(found))


def _audit(spark: SparkSession, args: argparse.Namespace) -> int:
    data = _bundle(spark, args)
    _show(audit.report(data.source1, data.source2, data.source3, data.truth).orderBy("section", "item", "value"))
    return 0


def _split(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = flows.split_table(_bundle(spark, args), args.dev)
    tsv.write_tsv(rows.withColumn("dev_sample", F.col("dev_sample").cast("int")), args.out, ["source1_entity_id"])
    _show(sampling.summary(rows).orderBy("country", "bucket"))
    return 0


def _rules(spark: SparkSession, args: argparse.Namespace) -> int:
    flows.rule_submission(_bundle(spark, args), args.out, args.threshold)
    return 0


def _blocks(spark: SparkSession, args: argparse.Namespace) -> int:
    data = _bundle(spark, args)
    keyed = kept(keys.rule_keys(records.with_views(flows.everything(data))).select("entity_id", "country", "keys"), "rule-keys")
    asked = rules.exploded(keyed.where("entity_id like 'S1-%'"))
    _show(evaluate.block_report(data.source1, _truth(data), rules.shared_keys(asked, rules.rule_postings(keyed))))
    return 0


def _pools(spark: SparkSession, args: argparse.Namespace) -> int:
    flows.save_pools(flows.candidate_pools(_bundle(spark, args), args.k), args.out)
    return 0


def _pilot(spark: SparkSession, args: argparse.Namespace) -> int:
    data = _bundle(spark, args)
    views = kept(records.with_views(flows.everything(data)), "views")
    chosen = kept(sampling.select_pilot(views.where("entity_id like 'S1-%'"), _truth(data), args.size, args.seed), "pilot")
    n = _truth(data).groupBy("query_id").agg(F.count("*").alias("match_count"))
    ids = chosen.select("entity_id", "country").join(n, F.col("entity_id") == F.col("query_id"), "left").select(F.col("entity_id").alias("source1_entity_id"), "country", F.coalesce("match_count", F.lit(0)).alias("match_count"))
    digest = tsv.write_manifest(ids, f"{args.out}/pilot_ids", ["source1_entity_id"])
    print(json.dumps({"seed": args.seed, "pilot_size": ids.count(), "manifest_sha256": digest}))
    if args.prepare_only:
        return 0
    truth = _truth(data).join(chosen.select(F.col("entity_id").alias("query_id")), "query_id", "left_semi")
    rows = kept(keys.exploded(keys.weighted_keys(views)), "keys")
    asked = rows.where("entity_id like 'S1-%'").join(chosen.select("entity_id"), "entity_id", "left_semi")
    postings = index.projected(index.indexed_only(rows), asked)
    stats = kept(index.statistics(postings), "statistics")
    ranks = kept(retrieve.ranked(retrieve.scores(asked, postings, stats, index.populations(flows.everything(data)), args.legacy, False)), "ranks")
    lost = evaluate.losses(truth, rows.select("entity_id", "country", "key"), index.usable(stats, args.legacy).select("country", "key"), ranks)
    tsv.write_tsv(evaluate.loss_table(lost, truth, views), f"{args.out}/losses", ["source1_id", "true_candidate_id"])
    _show(evaluate.at_k(chosen.select("entity_id", "country"), truth, ranks).orderBy("grp", "k"))
    _show(evaluate.posting_sizes(asked, stats, args.legacy).orderBy("family"))
    return 0


def _rerank(spark: SparkSession, args: argparse.Namespace) -> int:
    _show(flows.rerank_report(_bundle(spark, args), flows.load_pools(spark, args.pools, args.pool_size)).orderBy("ranking", "grp", "k"))
    return 0


def _ablation(spark: SparkSession, args: argparse.Namespace) -> int:
    _show(flows.ablation(_bundle(spark, args)).orderBy("mode", "grp", "k"))
    return 0


def _examples(spark: SparkSession, args: argparse.Namespace) -> int:
    data = _bundle(spark, args)
    rows = flows.everything(data)
    _show(audit.example_lines(audit.pair_examples(_truth(data), rows)))
    _show(audit.family_overlap(_truth(data), keys.exploded(keys.enhanced_keys(records.with_views(rows)))).orderBy("country", "family"))
    return 0


def _train(spark: SparkSession, args: argparse.Namespace) -> int:
    data, pools = _bundle(spark, args), flows.load_pools(spark, args.pools)
    best = evaluate.at_k(data.source1.select("entity_id", "country"), _truth(data), pools).where("grp = 'all' and k = -1").first()
    model.gate(best["oracle_macro_f05"], args.least_oracle)
    fitted = model.fit(flows.cached_features(data, pools, args.features), args.rounds)
    fitted.save(spark, args.out)
    print(json.dumps({"signature": model.signature(fitted)}))
    return 0


def _score(spark: SparkSession, args: argparse.Namespace) -> int:
    fitted = boosting.load(spark, args.model)
    if args.signature and model.signature(fitted) != args.signature:
        raise ValueError("the model is not the one that was saved")
    print(*flows.score_saved_pools(_bundle(spark, args), flows.load_pools(spark, args.pools, args.k), fitted, args.out, args.threshold))
    return 0


def _sweep(spark: SparkSession, args: argparse.Namespace) -> int:
    data, fitted = _bundle(spark, args), boosting.load(spark, args.model)
    scored = kept(model.predict(fitted, flows.cached_features(data, flows.load_pools(spark, args.pools), args.features)).select("query_id", "candidate_id", "rank", "probability"), "scored")
    _show(evaluate.threshold_sweep(data.source1.select("entity_id", "country"), _truth(data), scored, args.thresholds, args.cutoffs).orderBy("cutoff", "threshold"))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kithline", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, about: str, truth: bool | None = True) -> argparse.ArgumentParser:
        """truth: needed, not taken, or (None) no sources at all."""
        one = commands.add_parser(name, help=about, description=about)
        one.set_defaults(run=run)
        if truth is not None:
            for source in ("source1", "source2", "source3", *(("truth",) if truth else ())):
                one.add_argument(f"--{source}", required=True)
        return one

    one = command("evaluate", _evaluate, "macro F0.5, pair precision and recall, singleton accuracy of a result file", None)
    one.add_argument("--truth", required=True), one.add_argument("--predictions", required=True), one.add_argument("--source1", help="adds a report by country")
    one = command("validate", _validate, "checks result files; exit code 1 if they don't pass", None)
    one.add_argument("matching"), one.add_argument("--source1", required=True), one.add_argument("--candidates"), one.add_argument("--check-ids", nargs="+", help="files that have all ids that may be matched")
    command("audit", _audit, "profiles of the sources, anomalies of the truth")
    one = command("split", _split, "stratified split with its dev sample")
    one.add_argument("--out", required=True), one.add_argument("--dev", type=int, default=50_000)
    one = command("rules", _rules, "rule-based results", False)
    one.add_argument("--out", required=True), one.add_argument("--threshold", type=float, default=RULE_THRESHOLD)
    command("blocks", _blocks, "recall of shared keys, whole and shortlisted")
    one = command("pilot", _pilot, "a stratified pilot: its ids, recall at k, losses and posting sizes")
    one.add_argument("--out", required=True), one.add_argument("--size", type=int, default=2000), one.add_argument("--seed", type=int, default=SEED)
    one.add_argument("--prepare-only", action="store_true"), one.add_argument("--legacy", action="store_true")
    one = command("rerank", _rerank, "recall and best reachable F0.5 of stored pools in three orders, by group")
    one.add_argument("--pools", required=True), one.add_argument("--pool-size", type=int, default=1000)
    command("ablation", _ablation, "recall by sets of key families")
    command("examples", _examples, "true pairs in numbers, and the key families that they share")
    one = command("pools", _pools, "stores the first k candidates of every query", False)
    one.add_argument("--out", required=True), one.add_argument("-k", type=int, default=max(CUTOFFS))
    one = command("train", _train, "trains the pair model on stored pools")
    one.add_argument("--pools", required=True), one.add_argument("--features", required=True), one.add_argument("--out", required=True)
    one.add_argument("--rounds", type=int, default=150), one.add_argument("--least-oracle", type=float, default=ORACLE_GATE)
    one = command("score-pools", _score, "results and candidates from stored pools and a trained model", False)
    one.add_argument("--pools", required=True), one.add_argument("--model", required=True), one.add_argument("--out", required=True), one.add_argument("--signature")
    one.add_argument("-k", type=int, default=max(CUTOFFS)), one.add_argument("--threshold", type=float, default=MODEL_THRESHOLD)
    one = command("k-sweep", _sweep, "macro F0.5 by cutoff and threshold")
    one.add_argument("--pools", required=True), one.add_argument("--model", required=True), one.add_argument("--features", required=True)
    one.add_argument("--cutoffs", type=int, nargs="+", default=CUTOFFS), one.add_argument("--thresholds", type=float, nargs="+", default=[MODEL_THRESHOLD])
    return top


def main(args: list[str] | None = None) -> int:
    wanted = parser().parse_args(args)
    return wanted.run(SparkSession.builder.getOrCreate(), wanted)


if __name__ == "__main__":
    raise SystemExit(main())
