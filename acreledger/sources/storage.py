"""Where jobs keep written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from acreledger.session import RELEASE, settings

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and intermediate tables.

    Only a session within one process may run without it; then a temporary folder is
    made and remembered in the session.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    root = spark.conf.get("acreledger.local.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="acreledger-")
        spark.conf.set("acreledger.local.dir", root)
    return root


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the shared folder and return a scan of the files.

    Cuts lineage where several branches need the same result: branches re-read
    files instead of recomputing, also after an executor loss. What was shuffled for
    it is removed once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/acreledger/{spark.sparkContext.applicationId}/staged/{label}-{uuid.uuid4().hex}"
    with settings(spark, RELEASE):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
