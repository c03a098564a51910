"""Registered queries over pools of more than 20 candidates."""

import pytest

from kithline.operators import model, rules
from kithline.plans.catalog import QUERIES, Linkage

N = 720


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """240 queries with some 240 candidates each; matches share the name, but so do 40 others."""
    folder = f"file://{tmp_path_factory.mktemp('parts')}"
    rows = [(i, f"amber metal bolt lot{i // 60}", f"Brand#{i % 5}", "STANDARD TIN", 2, 1000.0 + i // 6) for i in range(N)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return folder


def test_cutoffs_differ(spark, sf_dir):
    got = {r.cutoff: r for r in QUERIES["cutoff_sweep"](spark, sf_dir).collect()}
    assert sorted(got) == [20, 50, 100, 150, 300]
    few = [got[k].predicted_pairs for k in (20, 50)]
    assert few[0] < few[1] <= got[300].predicted_pairs


def test_pair_model_scores_whole_pools_of_all_queries(spark, sf_dir, monkeypatch):
    asked = []

    def short(rows, rounds=150):
        asked.append((rounds, {r.split for r in rows.select("split").distinct().collect()}))
        return fit(rows, rounds=2)

    fit = model.fit
    monkeypatch.setattr(model, "fit", short)
    got = QUERIES["pair_model"](spark, sf_dir).groupBy("query_id", "split").count().collect()
    assert asked == [(150, {"train"})]
    assert len(got) == N // 3 and {r.split for r in got} == {"train", "valid"}
    assert min(r["count"] for r in got) > 20


@pytest.mark.parametrize("name", ["pair_features_all19", "route_pool"])
def test_pools_go_beyond_20(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).groupBy("query_id").count().collect()
    assert len(got) == N // 3 and min(r["count"] for r in got) > 20


@pytest.mark.parametrize("name", ["recall_at_k", "matches_subset_candidates", "ablation_families"])
def test_pools_are_not_listed_to_be_counted(spark, sf_dir, name):
    """Ranking all candidates in a window takes disk for every hit."""
    assert "Window" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["pair_features_all19", "pair_features_base", "pair_rank_name", "pair_rank_name_address", "route_pool", "loss_table"])
def test_pairs_are_not_shuffled(spark, sf_dir, name):
    """What is above the search neither joins nor ranks pairs."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan.split("MapInArrow")[0] for x in ("Join", "Window", "Aggregate", "Repartition"))


def test_rule_postings_are_planned_once(spark, sf_dir):
    """A plan that repeats them takes the driver's memory: their joins are those with queries, and that of pairs with their counts."""
    plan = rules.candidates(*Linkage(spark, sf_dir).rule_parts())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3
