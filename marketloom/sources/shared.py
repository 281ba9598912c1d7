"""Where jobs keep checkpoints and intermediate tables."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Only a session whose executors are threads of this process (master ``local`` or
    ``local[...]``) falls back to a temporary folder when that setting is missing; anywhere
    else its absence is an error, as executors could not see the files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="marketloom-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Spark's own switch: shuffle files of a command go when it ends, not when the driver's collector happens to find them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage through a written table that survives executor loss. The write's shuffle files go with its end."""
    spark = df.sparkSession
    path, before = shared_dir(spark, purpose), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
