"""Session defaults and the few settings that jobs read back from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "freightdocs", cpus: str | int = "*", partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # rules over texts cost far more than their bytes tell: small shuffles keep a task for each core
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        # no call site for each of the thousands of column expressions of a rule chain
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def working_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream state below the folder that all executors share.

    Without ``spark.checkpoint.dir`` only a local session goes on, with a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="freightdocs-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and go on from the written table.

    Unlike ``checkpoint()`` this computes the frame once, keeps it columnar, and what
    follows survives the loss of the executors that made it.
    """
    path = working_dir(df.sparkSession, name)
    df.write.parquet(f"{path}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/table")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
