"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: bound what a Python worker holds, whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 * 1024 * 1024
#: What a Python worker keeps from task to task; an operator that keeps nothing empties it.
KEPT: dict = {}
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and name a checkpoint folder where the session has none (as in tests)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Empty what this Python worker keeps. A function of the module, so that a task sent by value calls it here."""
    KEPT.clear()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever they are called."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_results(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The input columns that stay beside results of these names: a result replaces an input column of its name."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def map_column(df: DataFrame, column: str, results: T.StructType, job: Callable[[], Callable[[list], list[tuple]]], keeps: bool = False) -> DataFrame:
    """Append result columns that Python computes from one column, batch by batch, where the rows are.

    ``job()`` runs once in each task and returns the function from a batch's
    values to one tuple a row. Other columns pass through as they are; input
    columns with the name of a result are replaced. Only a job that ``keeps`` may
    use KEPT; workers serve one operator after another.
    """
    names = [f.name for f in results]
    keep = with_results(df, names)
    value = free_name(df, "value_")
    source = df.select(*(F.col(quoted(c)) for c in keep), F.col(quoted(column)).alias(value))
    schema = T.StructType([f for f in source.schema if f.name != value] + list(results))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        of = job()
        for batch in batches:
            rows = of(batch.column(len(keep)).to_pylist())
            found = zip(*rows, strict=True) if rows else [()] * len(names)
            types = [to_arrow(f.dataType) for f in results]
            arrays = [pa.array(list(x), type=t) for x, t in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=[*keep, *names])

    return source.mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, to_arrow(f.dataType)) for f in kind])
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}[kind]


def fields(spec: str) -> T.StructType:
    """``"n long, ids array<string>"`` as a schema."""
    return T._parse_datatype_string(spec)


def crc_rest(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null for null."""
    return F.crc32(F.col(quoted(column)).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of the columns ``by``; no shuffle of the rows themselves.

    The hashes of the smallest are read first; the sample is a filter on the
    frame. All rows stay if they are few enough. Repeats of a row at the cut are
    left out together.
    """
    hashed = F.xxhash64(*(F.col(quoted(c)) for c in by))
    least = [r[0] for r in df.select(hashed.alias("h")).orderBy("h").limit(rows + 1).collect()]
    return df if len(least) <= rows else df.filter(hashed < least[-1])


def fair_shares(sizes: dict[str, int], rows: int) -> dict[str, int]:
    """``rows`` dealt to groups of these sizes: equal shares, and what small groups leave goes to the larger ones."""
    out = {}
    for n, name in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        out[name] = min(sizes[name], rows // (len(sizes) - n))
        rows -= out[name]
    return out


def distinct_sample(df: DataFrame, by: list[str], group: str, rows: int) -> list[tuple[str, int]]:
    """(group, hash) of at most ``rows`` distinct values of the columns ``by``, which every group shares in.

    Copies count once, so they neither fill nor empty a sample. A group gives
    those with the smallest xxhash64 of ``by``. Only hashes are shuffled: of
    evenly spread hashes those below a bound a little above the group's share
    are ordered, so no task meets all hashes of a group.
    """
    pairs = df.select(F.col(quoted(group)).alias("g"), F.xxhash64(*(F.col(quoted(c)) for c in by)).alias("h")).distinct()
    sizes = {r.g: r.n for r in pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {g: n for g, n in fair_shares(sizes, rows).items() if n}
    if not shares:
        return []
    least, span = -(1 << 63), 1 << 64
    # a share and six standard deviations: fewer hashes than the share are as good as never below the bound
    bounds = [(g, n, min(-least - 1, least + int((n + 6 * n**0.5 + 20) / sizes[g] * span))) for g, n in shares.items()]
    wide = df.sparkSession.createDataFrame(bounds, "g string, share long, most long")
    low = pairs.join(F.broadcast(wide), "g").filter("h <= most")
    ranked = low.withColumn("rank_", F.row_number().over(Window.partitionBy("g").orderBy("h"))).filter("rank_ <= share")
    return sorted((r.g, r.h) for r in ranked.select("g", "h").collect())


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, total_bytes: int, key: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of the labelled documents for a fit on the driver, in a fixed order.

    ``learn`` says by the key which labels may be learned from. At most ``rows``
    documents (those with the smallest hash of their key), and of these the first
    whose texts are ``total_bytes`` long together. A key with several labels has
    the largest, a key with several texts the smallest; null labels, keys and
    texts are left out.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(quoted(key)).alias("k"), F.col(quoted(label)).cast("int").alias("y")).dropna()
    known = known.filter(F.col("y").isin(0, 1)).withColumnRenamed("k", key).filter(learn).withColumnRenamed(key, "k").groupBy("k").agg(F.max("y").alias("y"))
    # labels without a document are no loss: they are few, and the sample is a sample
    chosen = [(r.k, r.y) for r in known.orderBy(F.xxhash64("k"), "k").limit(rows).collect()]
    if not chosen:
        return []
    wanted = spark.createDataFrame(chosen, T.StructType([T.StructField("k", known.schema["k"].dataType), T.StructField("y", T.IntegerType())]))
    texts = docs.select(F.col(quoted(key)).alias("k"), F.col(quoted(text)).alias("t")).dropna().join(F.broadcast(wanted), "k")
    sizes = {r.k: r.n for r in texts.groupBy("k").agg(F.min(F.octet_length("t")).alias("n")).collect()}
    fit, total = [], 0
    for k, y in chosen:
        if k in sizes and total + sizes[k] <= total_bytes:
            fit.append((k, y))
            total += sizes[k]
    if not fit:
        return []
    few = spark.createDataFrame(fit, wanted.schema)
    found = {r.k: (r.t, r.y) for r in texts.drop("y").join(F.broadcast(few), "k").withColumn("n", F.octet_length("t")).groupBy("k").agg(F.min(F.struct("n", "t"))["t"].alias("t"), F.max("y").alias("y")).collect()}
    return [found[k] for k, _ in fit]


def logistic(x):  # noqa: ANN001, ANN201
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def newton_logistic(x, y, ridge: float = 1.0, rounds: int = 30):  # noqa: ANN001, ANN201
    """Weights, the constant last, of a ridge-penalised logistic regression."""
    import numpy as np

    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(rounds):
        p = logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
