"""Session defaults for local runs; a cluster's own settings win."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", app: str = "veldt", **conf: str) -> SparkSession:
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("VELDT_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=base | conf).getOrCreate()
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        # one machine: driver and executors share its folders
        context.setCheckpointDir(tempfile.mkdtemp(prefix="veldt-"))
    return spark
