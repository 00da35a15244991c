"""Sinks: Parquet, JSON and CSV layouts and idempotent replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreledger.session import RELEASE, settings
from acreledger.sources.versioned import Versioned


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


# Fixed value: for partitioned writes without a shuffle: tasks of 128 MB of shuffle, so that files are few, which hold up
# to so many files open and don't sort; beyond these Spark sorts the rest.
SPREAD = {
    **RELEASE,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.maxConcurrentOutputFileWriters": "128",
    "spark.sql.parquet.compression.codec": "zstd",
}


def write_partitioned(df: DataFrame, path: str, cols: Sequence[str], spread: bool = False) -> None:
    """Replace only the partitions present in ``df``.

    The rebalance hint groups rows by partition value and lets AQE split a hot
    value, and merge small ones, by measured size: few files per directory and no
    task that writes a whole hot month. With ``spread`` rows are written by the tasks
    they are in: no shuffle, a file per task and directory. For few partition values and
    rows that a join has just spread.
    """
    if spread:
        with settings(df.sparkSession, SPREAD):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path)
        return
    (
        df.hint("rebalance", *cols)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*cols)
        .parquet(path)
    )


def write_json_compact(df: DataFrame, path: str) -> None:
    """JSON with explicit nulls.  AQE merges output to its target size: one file for a small dimension, more for a large one."""
    df.hint("rebalance").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_by_month(df: DataFrame, path: str, date_col: str) -> None:
    """JSON lines, one directory per month."""
    df.withColumn("month_key", F.date_format(date_col, "yyyy_MM")).hint("rebalance", "month_key").write.mode("overwrite").partitionBy("month_key").json(path)


def write_csv_header(df: DataFrame, path: str) -> None:
    """CSV with header and quote escapes, in as few files as the data size asks for."""
    df.hint("rebalance").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_clustered(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Range-sorted files, so row-group min/max prune on the leading columns."""
    df.repartitionByRange(*cols).sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)


def write_sorted(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    """Files sorted by the columns, rows left in the partition they are in: row groups and pages prune, no shuffle.

    For rows that an operator has just spread evenly by a key, as a dedupe does.
    """
    df.sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str, schema) -> None:
    """Append with a fixed schema: missing columns become NULL, types are cast."""
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    df.select(*cols).write.mode("append").parquet(path)


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Delete-and-insert per key value: partitions of ``df`` replace the stored ones."""
    df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def publish_full(df: DataFrame, columns: dict[str, str], path: str) -> Versioned:
    """Publish a serving copy with a declared column list and types as the next version; readers have the last one until it is complete."""
    table = Versioned(df.sparkSession, path)
    table.replace(df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()]))
    return table


def publish_jdbc(df: DataFrame, columns: dict[str, str], url: str, table: str, batch_size: int = 10_000, **options) -> None:
    """The same into a relational target, written in parallel by the executors."""
    (
        df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])
        .write.format("jdbc").mode("overwrite")
        .options(url=url, dbtable=table, batchsize=batch_size, truncate="true", **options)
        .save()
    )
