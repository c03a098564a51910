"""Tab-separated sources and sinks."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTITY_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]


class DataValidationError(ValueError):
    """A source isn't what it should be."""


@dataclass(frozen=True)
class Bundle:
    source1: DataFrame
    source2: DataFrame
    source3: DataFrame
    truth: DataFrame | None = None


def load_tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """All columns as text, empty fields as empty text, quotes doubled inside quotes. More columns than required are fine."""
    try:
        head = spark.read.text(path).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if not head:
        raise DataValidationError(f"Empty TSV file: {path}")
    names = [c.strip('"') for c in head[0]["value"].rstrip("\r").split("\t")]
    missing = [c for c in required if c not in names]
    if missing:
        raise DataValidationError(f"{path} missing required columns {missing}; actual columns: {names}")
    schema = StructType([StructField(c, StringType()) for c in names])
    # a quoted field goes over several lines only if some line has an odd number of quotes; else files are read in splits
    broken = not spark.read.text(path).where("(length(value) - length(replace(value, '\"', ''))) % 2 = 1").isEmpty()
    return spark.read.csv(path, schema=schema, sep="\t", header=True, quote='"', escape='"', multiLine=broken, mode="FAILFAST", enforceSchema=True).na.fill("")


def load_entities(spark: SparkSession, path: str) -> DataFrame:
    return load_tsv(spark, path, ENTITY_COLUMNS)


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    return load_tsv(spark, path, TRUTH_COLUMNS)


def load_bundle(spark: SparkSession, source1: str, source2: str, source3: str, truth: str | None = None) -> Bundle:
    return Bundle(*(load_entities(spark, p) for p in (source1, source2, source3)), load_truth(spark, truth) if truth else None)


def _after_header(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The header's fields, and the lines after it: the header is known by its place in the file, not by its text."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    head = raw.first()
    if head is None:
        raise DataValidationError(f"Empty TSV file: {path}")
    first = raw.where((F.col("block") == 0) & (F.col("value") == head["value"])).groupBy("file").agg(F.min("place").alias("place"))  # a row a file
    return head["value"].rstrip("\r").split("\t"), raw.join(first, ["file", "place"], "left_anti").select("value")


def with_raggedness(spark: SparkSession, path: str) -> DataFrame:
    """Every row after the first with ``fields`` (split at tabs) and ``ragged``: whether their number isn't the header's. Rows that repeat the header are rows."""
    names, lines = _after_header(spark, path)
    return lines.select(F.split("value", "\t", -1).alias("fields")).withColumn("ragged", F.size("fields") != len(names))


def selected(frame: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows with these ids; an id that comes twice or not at all raises."""
    got = frame.join(ids.select(column).distinct(), column, "left_semi")
    counts = got.agg(F.count("*").alias("n"), F.countDistinct(column).alias("d")).first()
    if counts["n"] != counts["d"]:
        raise DataValidationError(f"Duplicate records by {column}")
    wanted = ids.select(column).distinct().count()
    if counts["d"] != wanted:
        raise DataValidationError(f"Missing {wanted - counts['d']} records by {column}")
    return got


def dev_only(frame: DataFrame, split: DataFrame, column: str = "entity_id") -> DataFrame:
    """Rows of the dev sample of a split table (dev_sample true or '1')."""
    dev = split.where(F.col("dev_sample").cast("string").isin("1", "true")).select(F.col("source1_entity_id").alias(column))
    return frame.join(dev, column, "left_semi")


def write_tsv(frame: DataFrame, path: str, order: list[str] | None = None, overwrite: bool = False) -> None:
    """One header a part file; refuses to overwrite unless told. Readers see all of it or nothing."""
    out = frame.sort(*order) if order else frame
    out.write.mode("overwrite" if overwrite else "errorifexists").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


class IncompleteOutput(ValueError):
    """Fewer rows were to be written than queries were asked."""


def write_results(results: DataFrame, queries: DataFrame, path: str) -> None:
    """Writes result rows after checking that every query has exactly one."""
    n, d = results.agg(F.count("*"), F.countDistinct("source1_entity_id")).first()
    if not n == d == queries.select("entity_id").distinct().count():
        raise IncompleteOutput("results must have one row for each query")
    write_tsv(results, path, ["source1_entity_id"])


def write_report(spark: SparkSession, report: DataFrame, path: str) -> None:
    """A small metric frame as one JSON document."""
    rows = [r.asDict(recursive=True) for r in report.collect()]
    spark.createDataFrame([(json.dumps(rows, default=float),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def write_manifest(frame: DataFrame, path: str, order: list[str]) -> str:
    """A small table as one file, rewritten only if it differs; the SHA-256 of its rows, header first."""
    import hashlib

    spark = frame.sparkSession
    rows = ["\t".join(frame.columns), *("\t".join("" if v is None else str(v) for v in r) for r in frame.sort(*order).collect())]
    try:
        if [r["value"] for r in spark.read.text(path, wholetext=True).collect()] == ["\n".join(rows) + "\n"]:
            return hashlib.sha256(("\n".join(rows) + "\n").encode()).hexdigest()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return hashlib.sha256(("\n".join(rows) + "\n").encode()).hexdigest()
