"""The pair model: training with equal weight for every query, the gate before it, scoring and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions.constants import FEATURES, MODEL_THRESHOLD, ORACLE_GATE
from kithline.operators import boosting, pooled
from kithline.operators.boosting import Trees


class GateClosed(ValueError):
    """The candidates are too incomplete to train on."""


class Leak(ValueError):
    """Partitions that must be apart share entities or matches."""


def weighted(rows: DataFrame) -> DataFrame:
    """Adds weight: one over the pool's size (the column ``pool_size``, or else it is counted), with mean 1 over all rows, so that every query weighs the same."""
    size = F.col("pool_size") if "pool_size" in rows.columns else F.count("*").over(Window.partitionBy("query_id"))
    totals = rows.agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("queries")).first()
    return rows.withColumn("weight", F.lit(totals["rows"] / max(totals["queries"], 1)) / size)


def gate(oracle: float, least: float = ORACLE_GATE) -> None:
    if oracle < least:
        raise GateClosed(f"oracle {oracle:.4f} is below {least}")


def checked_apart(train: DataFrame, other: DataFrame, train_truth: DataFrame, other_truth: DataFrame) -> None:
    """No query and no true match may be in both."""
    shared = lambda a, b, c: not a.select(c).intersect(b.select(c)).isEmpty()
    if shared(train, other, "query_id") or shared(train_truth, other_truth, "true_id"):
        raise Leak("train and validation share entities or matches")


def fit(rows: DataFrame, rounds: int = 150, depth: int = 4, rate: float = 0.08) -> Trees:
    """Boosted trees on rows with the features and ``label``, or on the rows of ``pooled.pools``."""
    if "steps" in rows.columns:
        return pooled.fit(rows, rounds, depth, rate)
    return boosting.fit(weighted(rows), FEATURES, rounds, depth, rate)


def signature(model: Trees) -> str:
    """Identifies a model by its feature order, bins and trees."""
    return model.signature()


def checked(model: Trees, expected: str, features: list[str]) -> None:
    if features != FEATURES or model.features != FEATURES or signature(model) != expected:
        raise ValueError("the model is not the one that was saved")


def predict(model: Trees, rows: DataFrame) -> DataFrame:
    """Adds probability."""
    return boosting.predict(model, rows)


#: Weights of the fixed logistic score, for use without a trained model.
FIXED = {"name_best": 4.0, "address_words": 2.0, "number_short": 2.5, "name_exact": 1.0, "number_conflict": -2.0}
FIXED_BIAS = -4.5


def fixed_score(rows: DataFrame) -> DataFrame:
    """Adds probability by fixed weights."""
    z = " + ".join(f"{w}D * {k}" for k, w in FIXED.items())
    return rows.withColumn("probability", F.expr(f"1.0D / (1.0D + exp(-({z} + {FIXED_BIAS}D)))"))


def accept(scored: DataFrame, threshold: float = MODEL_THRESHOLD) -> DataFrame:
    return scored.where(F.col("probability") >= threshold).withColumn("score", F.col("probability"))
