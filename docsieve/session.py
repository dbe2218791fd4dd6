"""Session defaults for local runs; a cluster's own settings always win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, app: str = "docsieve", **conf: str) -> SparkSession:
    """A local[N] session, N from the argument or the machine, with as many shuffle partitions."""
    n = cpus or os.cpu_count() or 1
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g"} | conf
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
