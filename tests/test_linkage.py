"""Retrieval, rules, evaluation, sampling, validation and sources on small inputs."""

import pytest
from pyspark.sql import functions as F

from kithline.functions.constants import FEATURES
from kithline.operators import audit, evaluate, features, index, keys, model, records, retrieve, rules, sampling, validate
from kithline.functions import constants
from kithline.sources import tsv

ENTITY = "entity_id string, business_name string, business_address string, country string"


def frames(spark, rows):
    data = spark.createDataFrame(rows, ENTITY)
    views = records.with_views(data)
    return data, views, keys.exploded(keys.weighted_keys(views))


ROWS = [
    ("S1-1", "Acme Bakery", "0141 Longstreet Rd", "US"), ("S2-00047", "Acme Bakery Inc", "141 Longstreet Road", "US"), ("S3-5", "Acme Motors", "9 Hill Road", "US"),
    ("S1-2", "Lonely Shop", "", "India"), ("S2-9", "Acme Bakery", "141 Longstreet Road", "India"),
]


def retrieval(spark, legacy=False):
    data, views, rows = frames(spark, ROWS)
    postings = index.indexed_only(rows)
    return data, views, rows, retrieve.ranked(retrieve.scores(rows.where("entity_id like 'S1-%'"), postings, index.statistics(postings), index.populations(data), legacy))


@pytest.mark.parametrize("legacy", [False, True])
def test_retrieval_stays_in_the_country_and_keeps_ids(spark, legacy):
    *_, ranks = retrieval(spark, legacy)
    got = [(r.query_id, r.candidate_id, r["rank"]) for r in ranks.orderBy("query_id", "rank").collect()]
    assert got[0] == ("S1-1", "S2-00047", 1) and all(c != "S2-9" for _, c, _ in got) and all(q != "S1-2" for q, _, _ in got)


def test_projection_changes_nothing(spark):
    data, _, rows, ranks = retrieval(spark)
    asked = rows.where("entity_id like 'S1-%'")
    few = index.projected(index.indexed_only(rows), asked)
    again = retrieve.ranked(retrieve.scores(asked, few, index.statistics(few), index.populations(data)))
    assert sorted(map(tuple, ranks.collect())) == sorted(map(tuple, again.collect()))


def test_repeats_count_once_for_df(spark):
    _, _, rows = frames(spark, [("S2-1", "Market Market", "0141 141", "US"), ("S3-1", "Market", "141", "US"), ("S1-1", "Market", "141", "US")])
    got = {r.key: (r.df, r.tf) for r in index.statistics(index.indexed_only(rows)).collect()}
    assert got["t:market"] == (2, 3) and got["n:141"] == (2, 3)


def test_route_pool_is_the_sequential_one(spark):
    import random

    rnd = random.Random(3)
    fams = ["t", "p", "a2", "n", "sg", "c"]
    rows = [(f"q{q}", f"S2-{i}", i + 1, rnd.sample(fams, rnd.randint(1, 2))) for q in range(12) for i in range(rnd.randint(1, 40))]
    ranks = spark.createDataFrame(rows, "query_id string, candidate_id string, rank int, routes array<string>")
    from kithline.functions.constants import POOL_GROUPS

    for limit in (2, 3, 7, 12, 100):
        got = {(r.query_id, r.candidate_id) for r in retrieve.route_pool(ranks, limit).collect()}
        want = set()
        for q in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == q]
            if limit < 4:
                want |= {r[:2] for r in own[:limit]}
                continue
            taken = [r for r in own[: limit // 2]]
            share = (limit - limit // 2) // len(POOL_GROUPS)
            for g in POOL_GROUPS:
                taken += [r for r in own if r not in taken and set(r[3]) & set(g)][:share]
            taken += [r for r in own if r not in taken][: limit - len(taken)]
            want |= {r[:2] for r in taken}
        assert got == want, limit


def test_index_round_trip_and_staleness(spark, tmp_path):
    data, _, rows, _ = retrieval(spark)
    postings = index.indexed_only(rows)
    path = f"file://{tmp_path}/index"
    index.save(postings, index.statistics(postings), index.populations(data), path, "v1")
    back, stats, _ = index.load(spark, path, "v1")
    assert back.count() == postings.count() and stats.count() > 0
    with pytest.raises(index.IndexMismatch):
        index.load(spark, path, "v2")
    with pytest.raises(Exception, match="(?i)exists"):
        index.save(postings, stats, index.populations(data), path, "v1")


def test_stored_pools(spark):
    *_, ranks = retrieval(spark)
    stored = retrieve.pools(ranks)
    assert retrieve.unpacked(stored, 1).count() == 1
    with pytest.raises(retrieve.CorruptPool):
        retrieve.unpacked(stored.withColumn("routes", F.expr("slice(routes, 1, 0)")), 5)


def test_rules_end_to_end(spark):
    _, views, _ = frames(spark, ROWS)
    keyed = keys.rule_keys(views)
    pairs = rules.candidates(rules.exploded(keyed.where("entity_id like 'S1-%'")), rules.rule_postings(keyed))
    chosen = rules.accepted(rules.scored(pairs, records.signature(views)))
    out = {r[0]: r[1] for r in rules.submission(views.where("entity_id like 'S1-%'"), chosen).collect()}
    assert out == {"S1-1": "S2-00047", "S1-2": ""}


def pair_frame(spark, a, b, candidate="S2-1"):
    data = spark.createDataFrame([("S1-1", *a, "US"), (candidate, *b, "US")], ENTITY)
    pairs = spark.createDataFrame([("S1-1", candidate, 0.5, ["t"])], "query_id string, candidate_id string, relative_score double, routes array<string>")
    return features.all_features(pairs, records.pair_view(records.with_views(data)))


def test_pair_features(spark):
    near = pair_frame(spark, ("Acme Bakery", "141 Longstreet Rd"), ("Acme Bakery", "0141 Longstreet Road")).first()
    assert near.name_exact == 1 and near.address_words == 1 and near.number_medium == 1 and near.number_long == 0
    empty = features.pair_rank(pair_frame(spark, ("", ""), ("", "")), False).first()
    assert empty.name_exact == 0 and empty.pair_rank == 0 and empty.missing_address == 1
    rows = [pair_frame(spark, ("Acme", "1 x"), ("Acme", "1 x"), c).first().asDict() for c in ("S2-1", "S2-999", "S3-999")]
    differ = {k for k in FEATURES if len({r[k] for r in rows}) > 1}
    assert differ == {"source3"} and len(FEATURES) == 19
    far = features.pair_rank(pair_frame(spark, ("Acme", "77 Hill Road"), ("Acme", "141 Longstreet Road"))).first().pair_rank
    same = features.pair_rank(pair_frame(spark, ("Acme", "141 Longstreet Road"), ("Acme", "141 Longstreet Road"))).first().pair_rank
    assert same > far


def evaluation(spark, truth, chosen, queries):
    q = spark.createDataFrame(queries, "entity_id string, country string")
    t = spark.createDataFrame(truth, "query_id string, true_id string")
    c = spark.createDataFrame(chosen, "query_id string, candidate_id string, probability double, rank int")
    return q, t, c


def test_macro_metrics_and_empty_pools(spark):
    q, t, c = evaluation(spark, [("a", "S2-1"), ("a", "S3-2")], [("a", "S2-1", 0.9, 1)], [("a", "US"), ("b", "India")])
    got = evaluate.evaluated(q, t, c).first()
    assert got.macro_f05 == pytest.approx((5 / 6 + 1) / 2) and got.singleton_accuracy == 1
    by = {r.country: r.macro_f05 for r in evaluate.report(evaluate.per_query(q, t, c), "country").collect()}
    assert by == {"US": pytest.approx(5 / 6), "India": 1.0}
    with pytest.raises(evaluate.EvaluationInputError):
        evaluate.evaluated(q.where("entity_id = 'b'"), t, c)
    q, t, c = evaluation(spark, [("b", "S2-1")], [], [("a", "US"), ("b", "US")])
    got = evaluate.threshold_sweep(q, t, c, [0.5]).first()
    assert got.entities == 2 and got.macro_f05 == 0.5 and got.predicted_empty_rate == 1


def test_threshold_sweep_values(spark):
    q, t, c = evaluation(
        spark, [("a", "x"), ("a", "gone"), ("c", "y")], [("a", "x", 0.9, 1), ("a", "z", 0.8, 2), ("b", "w", 0.1, 1), ("c", "y", 0.6, 1)], [("a", "US"), ("b", "US"), ("c", "US")]
    )
    got = evaluate.threshold_sweep(q, t, c, [0.7]).first()
    assert got.macro_f05 == pytest.approx((0.5 + 1 + 0) / 3) and got.pair_precision == 0.5 and got.pair_recall == pytest.approx(1 / 3) and got.singleton_accuracy == 1
    assert got.oracle_macro_f05 == pytest.approx((5 / 6 + 1 + 1) / 3)


def test_id_lists(spark):
    frame = lambda v: spark.createDataFrame([("S1-1", v)], "source1_entity_id string, matched_entity_ids string")
    evaluate.checked_ids(frame("S2-1,S3-2"))
    evaluate.checked_ids(frame(""))
    evaluate.checked_ids(frame(None))
    for bad, words in (("S1-1", "Malformed"), ("S2-1,S2-1", "Duplicate")):
        with pytest.raises(evaluate.EvaluationInputError, match=words):
            evaluate.checked_ids(frame(bad))


def test_distribution_places(spark):
    got = evaluate.distribution(spark.createDataFrame([(v,) for v in (5, 1, 9, 3)], "v bigint"), "v").first()
    assert (got["count"], got.p50, got.p90, got.p99, got["max"]) == (4, 3, 5, 5, 9)


def test_split_and_quotas(spark):
    rows = spark.createDataFrame([(f"S1-{i}", "US" if i % 2 else "India", i % 3) for i in range(60)], "source1_entity_id string, country string, match_count int")
    out = sampling.split(rows)
    assert {(r.entities, r.valid) for r in sampling.summary(out).collect()} == {(10, 1)}
    assert sampling.dev_sample(out, 4).where("dev_sample").count() == 4
    groups = spark.createDataFrame([("a", 40), ("b", 9), ("c", 1)], "g string, available long")
    dealt = lambda size, least: {r.g: r.quota for r in sampling.allocated(groups, ["g"], size, least).collect()}
    pilot = dealt(20, 1)
    assert sum(pilot.values()) == 20 and min(pilot.values()) == 1
    assert dealt(5, 0) == {"a": 4, "b": 1, "c": 0} and dealt(50, 1) == {"a": 40, "b": 9, "c": 1}
    assert dealt(3, 1) == {"a": 2, "b": 1, "c": 0} and dealt(2, 1) == {"a": 1, "b": 1, "c": 0}
    for size in (0, 51):
        with pytest.raises(ValueError, match="chosen"):
            dealt(size, 1)


def test_largest_remainders(spark):
    n = {f"g{i}": 3 + 7 * i % 23 for i in range(12)}
    groups = spark.createDataFrame(list(n.items()), "g string, available long")
    for size in (1, 7, 30, 61, sum(n.values())):
        share = {g: size * k / sum(n.values()) for g, k in n.items()}
        left = size - sum(int(x) for x in share.values())
        more = sorted(n, key=lambda g: (share[g] - int(share[g]), g), reverse=True)[:left]
        assert {r.g: r.quota for r in sampling.allocated(groups, ["g"], size).collect()} == {g: int(share[g]) + (g in more) for g in n}


def test_membership_leaves_pilot_ids_out(spark):
    rows = spark.createDataFrame([(f"S1-{i}", "US" if i % 2 else "India", "1", "valid" if i % 4 else "train", str(int(i % 3 > 0))) for i in range(80)], "source1_entity_id string, country string, bucket string, split string, dev_sample string")
    pilot = sampling.membership(rows, "valid", 10)
    assert pilot.count() == 10 and pilot.where("split <> 'valid' or dev_sample <> '1'").isEmpty()
    rest = sampling.membership(rows, "valid", 20, pilot)
    assert rest.count() == 20 and rest.join(pilot, "source1_entity_id").isEmpty()
    assert sampling.membership(rows, "train", 20).where("split = 'train'").count() == 20


def test_support_caps(spark):
    """A word and a number that nine records share: too many for the block rules, few enough for candidates."""
    one = spark.createDataFrame([("S1-1", "US", "t:amberly"), ("S1-1", "US", "n:4711")], "entity_id string, country string, key string")
    shared = spark.createDataFrame([(f"S2-{i}", "US", k, 9) for i in range(9) for k in ("t:amberly", "n:4711")], "entity_id string, country string, key string, df long")
    assert rules.supported(one, shared, constants.SUPPORT_BLOCK).isEmpty() and rules.supported(one, shared, constants.SUPPORT_RANK).count() == 9
    assert rules.supported(one, shared.where("entity_id <> 'S2-0'"), constants.SUPPORT_BLOCK).count() == 8


def test_reports_over_nothing(spark):
    none = spark.createDataFrame([], "v bigint")
    assert tuple(evaluate.distribution(none, "v").first()) == (0, 0, 0, 0, 0) and tuple(evaluate.plain_quantiles(none, "v").first()) == (0, 0, 0)
    some = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v bigint")
    assert tuple(evaluate.plain_quantiles(some, "v").first()) == (4, 3, 4)


def test_unranked_usable_link_fails(spark):
    truth = spark.createDataFrame([("S1-1", "S2-1")], "query_id string, true_id string")
    keys_ = spark.createDataFrame([("S1-1", "US", "t:a"), ("S2-1", "US", "t:a")], "entity_id string, country string, key string")
    ranks = spark.createDataFrame([], "query_id string, candidate_id string, rank int, score double")
    with pytest.raises(Exception, match="has no rank"):
        evaluate.losses(truth, keys_, keys_.select("country", "key").distinct(), ranks).collect()


def test_block_report(spark):
    queries = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-9"), ("S1-2", "S2-2")], "query_id string, true_id string")
    shared = spark.createDataFrame([("S1-1", "S2-1", 1), ("S1-1", "S2-3", 2), ("S1-2", "S2-4", 1)], "query_id string, candidate_id string, shared long")
    got = evaluate.block_report(queries, truth, shared, 1).first()
    assert (got.true_links, got.found, got.shortlisted, got.queries, got.median_pool) == (3, 1, 0, 2, 2)


def test_rows_like_the_header_are_rows(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text("a\tb\na\tb\n1\t2\t3\n\nx\ty\n", encoding="utf-8")
    got = [(tuple(r.fields), r.ragged) for r in tsv.with_raggedness(spark, f"file://{path}").collect()]
    assert got == [(("a", "b"), False), (("1", "2", "3"), True), (("",), True), (("x", "y"), False)]
    (tmp_path / "m.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"two\nlines"\tx\tUS\nS1-2\tplain\ty\tUS\n', encoding="utf-8")
    assert [r.business_name for r in tsv.load_entities(spark, f"file://{tmp_path}/m.tsv").orderBy("entity_id").collect()] == ["two\nlines", "plain"]


def test_tsv_source_and_sink(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\textra\nS1-001\t"Acme ""A"", Inc."\t\tUS\t1\n', encoding="utf-8")
    row = tsv.load_entities(spark, f"file://{path}").first()
    assert (row.entity_id, row.business_name, row.business_address) == ("S1-001", 'Acme "A", Inc.', "")
    (tmp_path / "bad.tsv").write_text("entity_id\tbusiness_name\n", encoding="utf-8")
    with pytest.raises(tsv.DataValidationError, match="missing required column"):
        tsv.load_entities(spark, f"file://{tmp_path}/bad.tsv")
    with pytest.raises(FileNotFoundError):
        tsv.load_entities(spark, f"file://{tmp_path}/none.tsv")
    out = spark.createDataFrame([("S1-1", ""), ("S1-2", "S2-1")], "source1_entity_id string, matched_entity_ids string")
    queries = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    tsv.write_results(out, queries, f"file://{tmp_path}/out")
    assert tsv.load_truth(spark, f"file://{tmp_path}/out").count() == 2
    with pytest.raises(tsv.IncompleteOutput):
        tsv.write_results(out.limit(1), queries, f"file://{tmp_path}/out2")


GOOD = "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n"


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("", "empty file"), (GOOD.replace("\t", ","), "comma-separated header"), (GOOD.replace("matched", "other"), "unexpected header"), (GOOD + "S1-9 x\n", "no tab"), (GOOD + "S1-1\t\n", "duplicate rows"),
        (GOOD.replace("S3-1", "S2-1"), "duplicate ids in a list"), (GOOD.replace("S3-1", "S1-7"), "source 1 ids in a list"), (GOOD.replace("S3-1", "X1"), "ids without a known prefix"),
        (GOOD.replace("S3-1", "S3-8"), "unknown ids"), (GOOD.replace("S1-2\t\n", ""), "required rows missing"), (GOOD + "S1-3\t\n", "rows not asked for"),
    ],
)
def test_validator_rules(spark, tmp_path, text, rule):
    (tmp_path / "m.tsv").write_text(text, encoding="utf-8")
    (tmp_path / "c.tsv").write_text(GOOD.replace("matched", "candidate"), encoding="utf-8")
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    targets = spark.createDataFrame([("S2-1",), ("S3-1",)], "id string")
    found = validate.validate(spark, f"file://{tmp_path}/m.tsv", required, f"file://{tmp_path}/c.tsv", targets)
    assert rule in {f[1] for f in found if f[0] == "error"} and not validate.passes(found)


def test_validator_passes_and_warns(spark, tmp_path):
    (tmp_path / "m.tsv").write_text(GOOD, encoding="utf-8")
    (tmp_path / "c.tsv").write_text(GOOD.replace("matched", "candidate").replace(",S3-1", ""), encoding="utf-8")
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    found = validate.validate(spark, f"file://{tmp_path}/m.tsv", required, f"file://{tmp_path}/c.tsv")
    assert validate.passes(found) and {f[1] for f in found} == {"matches not in candidates", "ids not checked"}
    assert not validate.passes(validate.validate(spark, f"file://{tmp_path}/none.tsv", required))


def test_truth_anomalies(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "entity_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-3,S2-x"), ("S1-1", ""), ("bad", "S3-9"), ("S1-8", "S3-1")], "source1_entity_id string, matched_entity_ids string")
    got = {r.anomaly: r.n for r in audit.truth_anomalies(truth, ids("S1-1", "S1-2"), ids("S2-1"), ids("S3-1")).collect()}
    assert got == {
        "rows": 4, "duplicate_source1_rows": 1, "invalid_source1_references": 2, "missing_ground_truth_rows": 1, "duplicate_ids_in_lists": 1, "source1_ids_as_matches": 1, "malformed_match_ids": 1,
        "s2_matches": 1, "s3_matches": 2, "missing_target_references": 1,
    }


def test_profile(spark):
    rows = spark.createDataFrame([("S1-1", "a", "", " "), ("S1-01", "", "b", "US"), ("x", "a", "b", "US"), ("x", "a", "b", None)], ENTITY)
    got = audit.profile(rows, "S1").first().asDict()
    assert got == {"rows": 4, "malformed_ids": 2, "duplicate_ids": 2, "missing_names": 1, "missing_addresses": 1, "countries": 2}


def test_model_gate_and_weights(spark):
    with pytest.raises(model.GateClosed):
        model.gate(0.97)
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "query_id string")
    got = model.weighted(rows).groupBy("query_id").agg(F.sum("weight").alias("w")).collect()
    assert {round(r.w, 9) for r in got} == {1.5}
    with pytest.raises(model.Leak):
        t = spark.createDataFrame([("a", "S2-1")], "query_id string, true_id string")
        model.checked_apart(rows, rows, t, t)


def test_loss_reasons_in_order(spark):
    q = "query_id string, true_id string"
    truth = spark.createDataFrame([("q", "no"), ("q", "pruned"), ("q", "in"), ("q", "below")], q)
    keyed = spark.createDataFrame([("q", "US", "t:a"), ("q", "US", "t:b"), ("no", "US", "t:z"), ("pruned", "US", "t:a"), ("in", "US", "t:b"), ("below", "US", "t:b")], "entity_id string, country string, key string")
    ok = spark.createDataFrame([("US", "t:b")], "country string, key string")
    ranks = spark.createDataFrame([("q", "in", 100, 1.0), ("q", "below", 101, 0.5)], "query_id string, candidate_id string, rank int, score double")
    got = {r.true_id: r.reason for r in evaluate.losses(truth, keyed, ok, ranks).collect()}
    assert got == {"no": evaluate.NO_KEY, "pruned": evaluate.PRUNED, "in": evaluate.IN_TOP, "below": evaluate.BELOW}


def test_at_k_with_singletons(spark):
    q = spark.createDataFrame([("a", "US"), ("b", "US")], "entity_id string, country string")
    t = spark.createDataFrame([("a", "S2-1"), ("a", "S3-1")], "query_id string, true_id string")
    r = spark.createDataFrame([("a", "S2-1", 1), ("a", "S3-1", 2)], "query_id string, candidate_id string, rank int")
    got = evaluate.at_k(q, t, r).where("grp = 'all' and k = 20").first()
    assert got.true_links == 2 and got.oracle_macro_f05 == 1 and got.pair_recall == 1


def pools(spark):
    """Views of 90 records that share words and numbers, and what retrieval takes of them."""
    import random

    rnd = random.Random(8)
    names = ["amber", "bolts", "copper", "delta", "metals", "Acme"]
    rows = [(f"S{rnd.randint(1, 3)}-{i}", " ".join(rnd.sample(names, 2)), f"{rnd.randint(100, 112)} {rnd.choice(names)} Road", rnd.choice(["US", "India"])) for i in range(90)]
    rows += [("S1-900", "", "", "US")]
    data, _, keyed = frames(spark, rows)
    postings = index.indexed_only(keyed)
    return keyed.where("entity_id like 'S1-%'"), postings, index.statistics(postings), index.populations(data)


@pytest.mark.parametrize("hits", [300, 10**9])
def test_search_by_blocks_gives_the_same_pools(spark, monkeypatch, hits):
    from kithline.operators import search

    monkeypatch.setattr(search, "BLOCK_HITS", hits)
    monkeypatch.setattr(search, "BATCH", 7)
    parts = pools(spark)
    row = lambda r: (r.query_id, r.candidate_id, r.score, r["rank"], tuple(sorted(r.routes)))
    want = sorted(map(row, retrieve.ranked(retrieve.scores(*parts)).collect()))
    assert sorted(map(row, search.searched(*parts).collect())) == want
    assert sorted(map(row, search.searched(*parts, 3).collect())) == [r for r in want if r[3] <= 3]
    got = {r.query_id: (r.pairs, int(r.total)) for r in search.totals(*parts).collect() if r.pairs}
    assert got == {q: (sum(r[0] == q for r in want), sum(round(r[2] * 1e12) for r in want if r[0] == q)) for q in {r[0] for r in want}}


def test_search_ranks_wanted_pairs_once(spark):
    from kithline.operators import search

    parts = pools(spark)
    ranks = {(r.query_id, r.candidate_id): r["rank"] for r in retrieve.ranked(retrieve.scores(*parts)).collect()}
    some = [*list(ranks)[::3], list(ranks)[0], ("S1-900", "S2-1"), (list(ranks)[0][0], "S2-none")]
    only = spark.createDataFrame(some, "query_id string, candidate_id string")
    got = [((r.query_id, r.candidate_id), r["rank"]) for r in search.searched(*parts, None, only, False).collect()]
    assert sorted(got, key=str) == sorted(((p, ranks.get(p)) for p in set(some)), key=str)


def test_search_gives_views_labels_and_route_pools(spark, monkeypatch):
    from kithline.operators import search

    monkeypatch.setattr(search, "VIEW_HITS", 200)
    monkeypatch.setattr(search, "VIEW_BATCH", 7)
    parts = pools(spark)
    ranks = retrieve.ranked(retrieve.scores(*parts)).cache()
    ids = parts[0].unionByName(parts[1]).select("entity_id").distinct().where("not entity_id like '%7'")
    views = ids.select("entity_id", F.struct(F.upper("entity_id").alias("u"), F.array("entity_id").alias("l")).alias("view"))
    links = ranks.where("rank in (2, 5)").select("query_id", "candidate_id")
    found = search.searched(*parts, 4, None, False, views, links).collect()
    known = {r.entity_id for r in ids.collect()}
    want = {(r.query_id, r.candidate_id, r["rank"], int(r["rank"] == 2)) for r in ranks.where("rank <= 4").collect() if {r.query_id, r.candidate_id} <= known}
    assert {(r.query_id, r.candidate_id, r["rank"], r.label) for r in found} == want and len(found) == len(want)
    assert all(r.q.u == r.query_id and r.c.l == [r.candidate_id] for r in found)
    foreign = spark.createDataFrame([(q, next(i for i in sorted(known) if i.startswith("S2-"))) for q in known if q.startswith("S1-")], "query_id string, candidate_id string")
    got = {(r.query_id, r.candidate_id, r["rank"], r.wanted) for r in search.searched(*parts, None, foreign, False, views).collect()}
    of = {(r.query_id, r.candidate_id): r["rank"] for r in ranks.collect()}
    expected = {(r.query_id, r.candidate_id, of.get((r.query_id, r.candidate_id)), 1) for r in foreign.collect()}
    assert got - expected == set() and expected - got == set()
    assert any(g[2] is None for g in got)
    for limit in (3, 12):
        got = sorted((r.query_id, r["rank"]) for r in search.searched(*parts, None, None, False, pool=limit).collect())
        assert got == sorted((r.query_id, r["rank"]) for r in retrieve.route_pool(ranks, limit).collect())


def test_views_travel_in_short_form(spark, monkeypatch):
    """Records go to each of their blocks without the words and grams that their names hold; pairs have the whole views."""
    from kithline.operators import search

    rows = [(f"S{1 + i % 3}-{i}", f"amber copper {'xyz'[i % 3]}", "12 Delta Road" if i % 4 else "", "US") for i in range(24)] + [("S1-90", None, None, "US")]
    data, views, keyed = frames(spark, rows)
    postings = index.indexed_only(keyed)
    sent, by_block = [], search._by_block
    monkeypatch.setattr(search, "_by_block", lambda rows, blocks: sent.append(rows) or by_block(rows, blocks))
    parts = keyed.where("entity_id like 'S1-%'"), postings, index.statistics(postings), index.populations(data)
    got = search.searched(*parts, 5, None, False, records.packed_view(views).select("entity_id", "view"), unpack=records.unpacked_view()).collect()
    want = {r.entity_id: r.view for r in records.pair_view(views).collect()}
    assert got and all(r.q == want[r.query_id] and r.c == want[r.candidate_id] for r in got)
    assert sent[0].schema["view"].dataType.names == ["name", "skeleton", "address", "numbers"]


def test_queries_with_the_same_lists_share_a_block(spark, monkeypatch):
    """Else each block needs the names of all records."""
    from kithline.operators import search

    monkeypatch.setattr(search, "BLOCK_HITS", 4000)
    rows = [(f"S{1 + i % 3}-{i}", 'bdfgjklmnprt'[i // 60] * 8, "", "US") for i in range(720)]
    data, _, keyed = frames(spark, rows)
    postings = index.indexed_only(keyed)
    dealt, blocks = search._dealt(keyed.where("entity_id like 'S1-%'"), postings, index.statistics(postings), index.populations(data), None, True)
    assert blocks >= 12 and dealt.where("kind = 0").count() < 3 * 480


def test_sweep_counts_are_those_of_the_whole_grid(spark):
    q = spark.createDataFrame([("a", "US"), ("b", "US"), ("c", "US")], "entity_id string, country string")
    t = spark.createDataFrame([("a", "S2-1"), ("a", "S2-2"), ("a", "S2-2"), ("b", "S2-9")], "query_id string, true_id string")
    pairs = [("a", "S2-1", 0.5, 1), ("a", "S2-2", 0.7, 3), ("a", "S2-3", 0.9, 2), ("b", "S2-8", None, 1), ("c", "S2-4", 0.6, 4)]
    scored = spark.createDataFrame(pairs, "query_id string, candidate_id string, probability double, rank int")
    truth = {("a", "S2-1"), ("a", "S2-2"), ("b", "S2-9")}
    for r in evaluate.threshold_sweep(q, t, scored, [0.7, 0.5], [3, 2, 10]).collect():
        kept = {p[:2] for p in pairs if p[2] is not None and p[2] >= r.threshold and p[3] <= r.cutoff}
        assert (r.predicted_pairs, r.true_positives, r.true_pairs, r.entities) == (len(kept), len(kept & truth), 3, 3)


def test_link_losses_are_those_of_joins(spark):
    from kithline.operators import search

    data, views, keyed = frames(spark, [*ROWS, ("S3-8", "", "", "US"), ("S3-7", "Other Thing", "", "US")])
    postings = index.indexed_only(keyed)
    stats = index.statistics(postings).withColumn("cap", F.expr("if(key = 't:bakery', 0, cap)"))
    links = spark.createDataFrame([("S1-1", "S2-00047"), ("S1-1", "S3-5"), ("S1-1", "S2-9"), ("S1-1", "S3-8"), ("S1-2", "S3-7")], "query_id string, true_id string")
    asked, ok = keyed.where("entity_id like 'S1-%'"), index.usable(stats).select("country", "key")
    ranks = retrieve.ranked(retrieve.scores(asked, postings, stats, index.populations(data)))
    want = evaluate.loss_table(evaluate.losses(links, keyed.select("entity_id", "country", "key"), ok, ranks), links, views)
    found = search.searched(asked, postings, stats, index.populations(data), None, links.withColumnRenamed("true_id", "candidate_id"), False, evaluate.key_view(keyed, ok, views))
    got = evaluate.link_losses(found)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 5


def test_support_takes_no_list_of_a_word_or_number_apart(spark):
    rows = [(f"S{1 + i % 3}-{i}", f"Amber Copper{i % 20:02d}", f"{1000 + i // 60} Longstreet Road", "US") for i in range(240)]
    keyed = keys.rule_keys(records.with_views(spark.createDataFrame(rows, ENTITY)))
    asked, posts = rules.exploded(keyed.where("entity_id like 'S1-%'")), rules.rule_postings(keyed)
    got = rules.supported(asked, posts, 8)
    word, number = (lambda r: r[1].split()[1]), (lambda r: r[2].split()[0])
    pair = lambda a, b: word(a) == word(b) and number(a) == number(b)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0][:2] == "S1" and b[0][:2] != "S1" and pair(a, b)}
    assert {(r.query_id, r.candidate_id) for r in got.collect()} == want and {r.support for r in got.collect()} == {1}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in x and "query_id" in x and "candidate_id" in x for x in plan.split("\n"))
