"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a dictionary up to which it is broadcast or shipped to workers.
MAX_WORDS = 500_000


def session(app: str = "textwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library's jobs expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, in local mode, one of our own where it is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    path = path or os.environ.get("TEXTWARDEN_SHARED_DIR")
    if not path:
        path = tempfile.mkdtemp(prefix="spark-textwarden-")
        os.environ["TEXTWARDEN_SHARED_DIR"] = path
        sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """``df`` to be broadcast if it is counted to have ``most`` rows or fewer; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` by rows over ``partitions`` tasks (default: the session's shuffle partitions), for work on texts that costs more than moving them, where a file is one partition. What is read in as many partitions already stays as it is, and what comes from an exchange."""
    wanted = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or plan.execute().getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)
