"""Spark session with the settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution coalesces small shuffle partitions and splits the hot side of a join.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Methods of more bytecode are not compiled by the JVM; such stages run unfused, which is faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Call-site capture costs more than building the expressions it describes.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def shared_folder(spark: SparkSession) -> str:
    """New folder under the cluster's shared checkpoint folder.

    A temporary folder of this machine is used only by a local session without one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tallyhouse-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def local_session(cores: int | str = 8, app: str = "tallyhouse", **settings: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster pass SETTINGS to spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    local = {
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**SETTINGS, **local, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
