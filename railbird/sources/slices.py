"""Partitioned tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.plans import schema as S


def write_slices(df: DataFrame, path: str, force: bool = False, files_per_slice: int = 1) -> None:
    """Parquet by dataset and year. Slices already there stay as they are unless ``force`` overwrites them.

    A slice is spread over ``files_per_slice`` tasks by a salt, so a large one is not one task's work.
    """
    spark = df.sparkSession
    if not force:
        done = existing_slices(spark, path)
        if done is not None:
            df = df.join(F.broadcast(done), ["dataset", "year"], "left_anti")  # one row per slice
    salt = F.pmod(F.xxhash64("hand_id"), F.lit(files_per_slice))
    w = df.withColumn("_salt", salt).repartition("dataset", "year", "_salt").drop("_salt").write.partitionBy("dataset", "year")
    w.option("partitionOverwriteMode", "dynamic").mode("overwrite" if force else "append").parquet(path)


def existing_slices(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select("dataset", F.col("year").cast("long").alias("year")).distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def read_slices(spark: SparkSession, path: str, schema: str = S.HANDS) -> DataFrame:
    """The table with its declared schema; filters on dataset and year prune folders."""
    return spark.read.schema(schema).parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one CSV or JSON file."""
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)
