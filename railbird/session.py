"""Session helpers for scripts and tests; on a cluster the caller brings the session."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings the queries rely on; a caller's own session should carry them too.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("railbird")
    conf = {
        **DEFAULTS,
        "spark.driver.memory": os.environ.get("RAILBIRD_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        **conf,
    }
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
