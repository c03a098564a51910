"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def release() -> None:
    """Gives freed memory back to the system: workers are reused, and what one stage leaves would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it keeps what it has
        pass


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, text: str = "text") -> DataFrame:
    """``mapInArrow`` by slices of a bounded number of text bytes and of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kithline.llm.textscan import chunks

        try:
            for batch in batches:
                for part in chunks(batch, text):
                    got = work(part)
                    if got is not None:
                        yield got
        finally:
            release()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{os.path.abspath('spark-checkpoints')}" if spark.sparkContext.master.startswith("local[") else None
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/kithline-{uuid.uuid4().hex}"


def text_key() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("kith"), F.col("text")).alias("k2")]


def kind(df: DataFrame, column: str) -> str:
    """The type of a column, for schemas: ids are taken as they come."""
    return df.schema[column].dataType.simpleString()


def dropped(df: DataFrame) -> None:
    """Deletes the folder of a frame that ``written`` gave, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent().getParent()
        if path.getName().startswith("kithline-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "t", narrow: bool = False) -> DataFrame:
    """The frame, written once to the shared folder and read again: cuts lineage and survives lost executors.

    narrow: rows of a few numbers, which go to as few files as their size calls for
    instead of one for each core. Shuffle files go as soon as the frame is written, not
    when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("true", "false")}
    if narrow:
        settings["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = ("false", "true")
    before = {key: spark.conf.get(key, usual) for key, (_, usual) in settings.items()}
    try:
        for key, (value, _) in settings.items():
            spark.conf.set(key, value)
        df.write.mode("errorifexists").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def sample_fraction(total: int, most: int) -> float:
    return 1.0 if total <= most else most / total


def sampled(df: DataFrame, fraction: float, *keys: str) -> DataFrame:
    """Rows whose key hash is below the fraction: the same rows in every run and layout."""
    if fraction >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.lit(int(fraction * (1 << 30))))
