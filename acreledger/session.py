"""Session settings the jobs rely on."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings, safe to apply to any session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where the split costs one more shuffle behind the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # stream state spills to disk instead of filling executor heaps
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # state is on disk twice, in the executors and in the checkpoint: packed tighter than by default
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}
PARTITION_BYTES = 192 * 1024 * 1024


# a compressed column file becomes about four times as large in a shuffle
EXPANSION = 4
# and its rows, text keys among them, again four times as large when a task sorts them (36 million ledger rows of
# 0.58 GB: some 9 GB); AQE merges what turns out small
SORTED = 4

# Fixed value: for writes, whose plans run once: Spark removes a plan's shuffle files as soon as it has run, not when the
# driver happens to collect its garbage. Those of a stream's own batches stay until then.
RELEASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# For jobs that write rows where they are, sorted: a task reads 32 MB of files or shuffle, which it can sort
# in memory (some 1.8 million ledger rows); small files are packed; and Parquet is packed tighter.
IN_PLACE = {
    **RELEASE,
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.files.openCostInBytes": "1m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.parquet.compression.codec": "zstd",
}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Runtime settings for the jobs run inside, as before afterwards. Streams started inside keep them."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def input_listing(spark: SparkSession, path: str) -> tuple[int, str]:
    """Bytes of the files under a path, and a text that changes with them (names, sizes, times)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries = [(s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength(), s.getModificationTime()) for s in fs.listStatus(root)]
    return sum(e[1] for e in entries), repr(sorted(entries))


def configure(spark: SparkSession, shuffle_bytes: int | None = None) -> SparkSession:
    """Apply the settings; size shuffles for ``shuffle_bytes`` of shuffled data if given.

    AQE merges small shuffle partitions but splits only skewed joins and
    rebalances, so the initial number must fit the largest shuffle.
    """
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    if shuffle_bytes is not None:
        wanted = -(-shuffle_bytes // PARTITION_BYTES)
        spark.conf.set("spark.sql.shuffle.partitions", str(max(wanted, spark.sparkContext.defaultParallelism)))
    return spark
