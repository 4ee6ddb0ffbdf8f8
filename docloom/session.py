"""Session construction with the settings the library is tested with."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session; ``conf`` keys use ``__`` for dots.

    On a cluster the submit-time settings win for anything not named here: only
    settings that change results (time zone) or protect tasks (AQE, Arrow batch
    bytes) are set.
    """
    builder = SparkSession.builder.appName(app)
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:  # spark-submit has set a master of its own
        builder = builder.master(master or "local[8]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: its rows are written to the shared checkpoint folder and read from there.

    The folder is the one that spark.checkpoint.dir names; only where a local session has none, one of this machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        place = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            place = "file://" + tempfile.gettempdir() + "/docloom-checkpoints"
        context.setCheckpointDir(place)
    return df.checkpoint()
