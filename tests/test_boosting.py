"""The pair model's learner against pyspark.ml's, and what a round costs."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kithline.functions.constants import FEATURES
from kithline.operators import boosting, model


@pytest.fixture(scope="module")
def rows(spark):
    """60 queries with 5 to 24 candidates; few values a feature, so that both learners have the same splits."""
    rng, out = np.random.default_rng(7), []
    for q in range(60):
        for c in range(5 + q % 20):
            x = rng.integers(0, 9, len(FEATURES)) / 8
            label = int(x[0] + x[4] * x[7] + rng.normal(0, 0.2) > 1)
            out.append((f"S1-{q}", f"S2-{c}", *map(float, x), label))
    kinds = "".join(f", {f} double" for f in FEATURES)
    return spark.createDataFrame(out, f"query_id string, candidate_id string{kinds}, label int").repartition(5).cache()


def probabilities(scored):
    return {(r.query_id, r.candidate_id): r.probability for r in scored.select("query_id", "candidate_id", "probability").collect()}


def test_trees_are_those_of_pyspark(rows):
    trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=6, maxDepth=4, stepSize=0.08, seed=1)
    other = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), trees]).fit(model.weighted(rows.withColumn("label", F.col("label").cast("double"))))
    want = probabilities(other.transform(rows).withColumn("probability", vector_to_array("probability")[1]))
    got = probabilities(model.predict(model.fit(rows, 6), rows))
    assert got.keys() == want.keys() and np.mean([abs(got[k] - want[k]) < 1e-4 for k in want]) > 0.97


def test_a_round_takes_no_job(spark, rows):
    jobs = []
    for rounds in (2, 30):
        spark.sparkContext.setJobGroup(f"fit-{rounds}", "")
        model.fit(rows, rounds)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_trees_do_not_depend_on_tasks(rows, monkeypatch, tmp_path):
    one = model.fit(rows, 5)
    monkeypatch.setattr(boosting, "TASK_GROUPS", 50)  # several tasks, which exchange sums
    assert model.signature(model.fit(rows.repartition(9), 5)) == model.signature(one)
    one.save(rows.sparkSession, f"file://{tmp_path}/model")
    again = boosting.load(rows.sparkSession, f"file://{tmp_path}/model")
    model.checked(again, model.signature(one), FEATURES)


def test_bins(spark):
    """Values keep a bin of their own while there are few; else bins have about as many rows. Pool sizes that are known aren't counted."""
    few = spark.createDataFrame([(x / 4,) for x in range(5)] * 3, "a double")
    assert boosting.edges(few, ["a"]) == [[0, 1024, 2048, 3072]]
    many = spark.createDataFrame([(x / 1000,) for x in range(1000)], "a double")
    cuts = boosting.edges(many, ["a"])[0]
    sizes = np.bincount(np.searchsorted(cuts, np.rint(np.arange(1000) / 1000 * 4096), "left"))
    assert len(sizes) == 32 and sizes.min() >= 28 and sizes.max() <= 34
    sized = spark.createDataFrame([("a", 2), ("a", 2), ("b", 1)], "query_id string, pool_size int")
    assert "Window" not in model.weighted(sized)._jdf.queryExecution().optimizedPlan().toString()
    assert {r.query_id: r.weight for r in model.weighted(sized).collect()} == {"a": 0.75, "b": 1.5}
