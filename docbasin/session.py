"""Session settings that every plan of the library relies on, and tables written to the folder that a cluster shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution re-plans joins and splits skewed partitions; UTC and ANSI fix what dates and casts mean.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "docbasin", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | (conf or {})).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a local master does without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or f"file://{os.path.abspath('spark-warehouse')}/checkpoints").rstrip("/")


#: Rows of an Arrow batch between the JVM and a Python scanner of texts: few, as a batch's buffers are held whole on both sides.
BATCH_ROWS = 300


def arrow(df: DataFrame) -> DataFrame:
    """`df`, about to be scanned in Python: from here on its session's Arrow batches have at most BATCH_ROWS rows."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its rows are computed once, and its lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
