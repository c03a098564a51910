"""Pools of the pair model by classes of equal records, against the same pairs one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithline.functions.constants import FEATURES
from kithline.operators import boosting, model, pooled, search
from kithline.operators.boosting import Trees
from kithline.plans.catalog import QUERIES, Linkage
from kithline.sources import adapters

COPIES, KINDS = 5, 90


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Copies of records with names of one to four words, some without a name, of equal score, or far apart in number."""
    folder = f"file://{tmp_path_factory.mktemp('parts')}"
    words = ["amber", "bolt", "crate 12", "ductile ring", "Éclair S.A.", "plate", "ab"]
    kinds = [(None if i % 17 == 0 else " ".join(words[(i // 3 + j) % 7] for j in range(1 + i % 4)), f"Brand#{i % 4}", ["STANDARD TIN", "LARGE", ""][i % 3], i % 2, [999.0, 1000.5, 12.0][i % 3] + i // 30) for i in range(KINDS)]
    rows = [(7 * i + 7000 * c + (i * c) % 3, *kinds[i]) for c in range(COPIES) for i in range(KINDS)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").repartition(3).write.parquet(f"{folder}/part.parquet")
    return folder


def found(spark, sf_dir, k):
    link = Linkage(spark, sf_dir)
    return pooled.pools(link.records, link.population, *adapters.part_truth_shared(spark, sf_dir), k).collect()


@pytest.mark.parametrize("k", [4, 11, 300])
def test_pools_are_those_of_single_records(spark, sf_dir, k):
    link = Linkage(spark, sf_dir)
    halves = {r.source1_entity_id: r.split for r in link.split().collect()}
    expected = {(r.query_id, r.candidate_id): (halves[r.query_id], r.label, *boosting.stepped(np.array([r[f] for f in FEATURES])).tolist()) for r in link.featured(k, True).collect()}
    got = {}
    for r in found(spark, sf_dir, k):
        steps, pattern = np.frombuffer(r.steps, np.uint16).reshape(-1, len(FEATURES)), np.frombuffer(r.pattern, np.uint16)
        for q in r.queries:
            for c, p, label in zip(r.candidates, pattern, r.label):
                assert (q, c) not in got
                got[q, c] = (r.split, label, *steps[p].tolist())
    assert got == expected and {x[1] for x in got.values()} == {0, 1} and {x[0] for x in got.values()} == {"train", "valid"}


def test_copies_share_a_row(spark, sf_dir):
    got = found(spark, sf_dir, 300)
    queries = [q for r in got for q in r.queries]
    assert len(queries) == len(set(queries)) > 1.5 * len(got)


def test_crowded_classes_are_parted(spark, sf_dir, monkeypatch):
    whole = sorted(q for r in found(spark, sf_dir, 4) for q in r.queries)
    monkeypatch.setattr(pooled, "UNIT_QUERIES", 1)
    parts = found(spark, sf_dir, 4)
    assert sorted(q for r in parts for q in r.queries) == whole and len(parts) > len(found(spark, sf_dir, 4)) / 2


def test_pair_model_equals_the_model_of_single_pairs(spark, sf_dir, monkeypatch):
    fit = model.fit
    monkeypatch.setattr(model, "fit", lambda rows: fit(rows, rounds=3))
    got = {(r.query_id, r.candidate_id): (r.probability, r.label, r.split) for r in QUERIES["pair_model"](spark, sf_dir).collect()}
    link = Linkage(spark, sf_dir)
    rows = link.featured(labelled=True).join(link.split().select(F.col("source1_entity_id").alias("query_id"), "split"), "query_id").cache()
    scored = model.predict(fit(rows.where("split = 'train'"), rounds=3), rows)
    assert got == {(r.query_id, r.candidate_id): (r.p, r.label, r.split) for r in scored.withColumn("p", F.round("probability", 6)).collect()}


def test_no_row_for_a_pair_before_the_last_stage(spark, sf_dir, monkeypatch):
    """What is learned from has a row for the queries of a class."""
    seen = []
    monkeypatch.setattr(model, "fit", lambda rows: seen.append(rows.count()) or Trees(FEATURES, [[] for _ in FEATURES], [[0]], [[32]], [[0.0, 0.0]]))
    pairs = QUERIES["pair_model"](spark, sf_dir).where("split = 'train'").count()
    assert 0 < 20 * seen[0] < pairs


def test_margins_are_those_of_a_walk(spark):
    draw = np.random.default_rng(1)
    split, at, leaf = draw.integers(0, 5, (9, 15)), draw.integers(0, 33, (9, 15)), draw.normal(size=(9, 16))
    bins = draw.integers(0, 32, (5000, 5)).astype(np.uint8)

    def walk(x):
        total = 0.0
        for s, a, l in zip(split, at, leaf):
            node = 0
            while node < 15:
                node = 2 * node + 1 + int(x[s[node]] > a[node])
            total += l[node - 15]
        return total

    got = Trees([], [], split.tolist(), at.tolist(), leaf.tolist()).margins(bins)
    assert np.allclose(got[::97], [walk(x) for x in bins[::97]], atol=1e-12) and len(got) == 5000


def test_digits_are_rounded_as_spark_does(spark):
    p = np.concatenate([np.array([0.0, 1.0, 0.0000005, 0.0000015, 0.1234565, 0.9999995, 2.5e-7, 0.3000005, 0.7654325]), np.random.default_rng(2).random(500)])
    assert pooled._rounded(p).tolist() == [r.x for r in spark.createDataFrame([(float(x),) for x in p], "p double").select(F.round("p", 6).alias("x")).collect()]


def test_no_null_lists_go_to_python(spark, sf_dir):
    """Spark takes time for a batch's null lists at each of its rows."""
    link = Linkage(spark, sf_dir)
    rows, _ = search._dealt(*link.parts(3), link.population, link.true_lists, True)
    assert rows.where("items is null or parts is null or names is null").isEmpty()
