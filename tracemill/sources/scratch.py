"""The shared scratch folder for checkpoints and tables between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, below a temporary folder in local runs and the warehouse on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        folder = tempfile.mkdtemp(prefix="spark-tracemill-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` once below the scratch folder and returns a scan of it, so that what follows neither computes it again nor needs the executors that did."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
