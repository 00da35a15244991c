"""Hard negatives by slot-decomposed selection.

An anchor's positives each open a window of scores for their negatives, from a
lower to an upper limit below the positive's own score, and windows overlap. The
upper limits split the scores into disjoint slots. Tasks keep the top k of each
(anchor, slot), a window function merges them, and the top k below each upper
limit follow from the slots from the lowest to the highest: a slot's top k before
those of the slots beneath, cut to k. A window's lower limit then only shortens its list.

Anchors go out in blocks of bounded size; each block meets all rows where they
are, by matrix products. What moves is k rows for each task, anchor and slot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acreledger.llm.common import prepare, quoted, release
from acreledger.sources.storage import shared_dir

#: Numbers in the vectors of an anchor block (32 MB as doubles), anchors of a block at most, anchors of a tile.
BLOCK_NUMBERS, BLOCK_ANCHORS, TILE = 4 << 20, 1 << 15, 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1  # LEAST: no row


def whole_numbers(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * values.astype(np.float64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit integers; beyond these limits, the limit."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = [[sum(x * y for x, y in zip(u, v, strict=True)) for v in map(lambda r: [int(y) for y in r], b)] for u in map(lambda r: [int(x) for x in r], a)]
    return np.array([[min(MOST, max(LEAST + 1, x)) for x in row] for row in exact], dtype=np.int64).reshape(len(a), len(b))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and their ids, which ascend: ties go to the smaller id. ``scores`` is used up."""
    every = np.arange(len(scores))
    best, who = np.full((len(scores), k), LEAST), np.zeros((len(scores), k), np.int64)
    for i in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        best[:, i], who[:, i] = scores[every, at], ids[at]
        scores[every, at] = LEAST
        if (best[:, i] == LEAST).all():
            break
    return best, who


def better(best: np.ndarray, who: np.ndarray, more: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The top k of two lists of k, scores descending, ids ascending."""
    k = best.shape[-1]
    best, who = np.concatenate([best, more], axis=-1), np.concatenate([who, others], axis=-1)
    order = np.lexsort((who, ~best), axis=-1)[..., :k]
    return np.take_along_axis(best, order, -1), np.take_along_axis(who, order, -1)


class Block:
    """Anchors of one block: key, label and whole-number vector, by length of the vector."""

    def __init__(self, table: pa.Table, scale: float) -> None:
        self.keys = table.column("key").to_numpy()
        self.labels = table.column("label").to_numpy()
        vectors = table.column("v").combine_chunks()
        length = np.diff(vectors.offsets.to_numpy())
        self.by = {int(d): (np.flatnonzero(length == d), np.stack([whole_numbers(vectors[int(i)].values.to_numpy(), scale) for i in np.flatnonzero(length == d)])) for d in np.unique(length)}

    def search(self, batches: Iterator[pa.RecordBatch], scale: float, k: int, slots: int, allowed: Callable) -> Iterator[pa.RecordBatch]:
        """(anchor, slot, id, score): the top k of each anchor and slot among the rows of all batches.

        ``allowed(anchors, scores, same, slot)`` says which scores of these anchors count in the slot;
        ``same``: whether the labels agree. A row with the anchor's key never counts.
        """
        n = len(self.keys)
        best, who = np.full((n, slots, k), LEAST), np.zeros((n, slots, k), np.int64)
        for batch in batches:
            lists = batch.column(2)
            length = np.diff(lists.offsets.to_numpy())
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for d, (anchors, matrix) in self.by.items():
                rows = np.flatnonzero(length == d)
                if not len(rows):
                    continue
                rows = rows[np.argsort(ids[rows], kind="stable")]
                x = whole_numbers(flat[offsets[rows][:, None] + np.arange(d)], scale)
                for start in range(0, len(anchors), TILE):
                    a = anchors[start : start + TILE]
                    scores = products(matrix[start : start + TILE], x)
                    other = self.keys[a][:, None] != ids[rows][None, :]
                    same = self.labels[a][:, None] == labels[rows][None, :]
                    for s in range(slots):
                        found = top(np.where(other & allowed(a, scores, same, s), scores, LEAST), ids[rows], k)
                        best[a, s], who[a, s] = better(best[a, s], who[a, s], *found)
        there = np.nonzero(best > LEAST)
        columns = [pa.array(there[0], pa.int32()), pa.array(there[1], pa.int32()), pa.array(who[there]), pa.array(best[there])]
        for i in range(0, len(there[0]), 100_000):
            yield pa.RecordBatch.from_arrays([c[i : i + 100_000] for c in columns], names=["anchor", "slot", "id", "score"])


def best_of(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("place") <= k)


def block_negatives(rows: DataFrame, anchors: pa.Table, scale: float, positives: int, keep: int, low: int, high: int) -> DataFrame:
    """Results of one block of anchors: (anchor, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = rows.sparkSession
    block = spark.sparkContext.broadcast(Block(anchors, scale))
    kinds = "anchor int, slot int, id long, score long"

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        return block.value.search(batches, scale, positives, 1, lambda _, scores, same, __: same)

    near = best_of(rows.mapInArrow(nearest, kinds), positives).select("anchor", "place", "id", "score").toArrow()
    # at most ``positives`` rows an anchor: the windows of its positives, and its slots by distinct upper limit
    windows, by = [], {}
    for a, place, who, score in sorted(zip(*(near.column(c).to_pylist() for c in ("anchor", "place", "id", "score")), strict=True)):
        floor, ceiling = -(-low * score // 100), high * score // 100
        windows.append((a, who, score, floor, ceiling))
        if floor <= ceiling:
            by.setdefault(a, []).append((ceiling, floor))
    n = anchors.num_rows
    limits, floors = np.full((n, positives + 1), LEAST), np.full(n, MOST)
    for a, spans in by.items():
        distinct = sorted({c for c, _ in spans}, reverse=True)
        limits[a, : len(distinct)] = distinct
        floors[a] = min(f for _, f in spans)
    shared = spark.sparkContext.broadcast((limits, floors))

    def inside(a: np.ndarray, scores: np.ndarray, same: np.ndarray, slot: int) -> np.ndarray:
        upper, lowest = shared.value
        return ~same & (scores <= upper[a, slot][:, None]) & (scores > upper[a, slot + 1][:, None]) & (scores >= lowest[a][:, None])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        return block.value.search(batches, scale, keep, positives, inside)

    slots = best_of(rows.mapInArrow(below, kinds), keep)
    # at most keep * positives entries an anchor, in falling order of score
    lists = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("entries"))
    none = "CAST(array() AS array<struct<slot:int,place:int,id:bigint,score:bigint>>)"
    merge = f"(done, s) -> concat(array(slice(concat(filter(entries, x -> x.slot = s), coalesce(get(done, 0), {none})), 1, {keep})), done)"
    suffixes = F.expr(f"aggregate(sequence({positives - 1}, 0, -1), CAST(array() AS array<array<struct<slot:int,place:int,id:bigint,score:bigint>>>), {merge})")
    place = [int(np.flatnonzero(limits[a] == ceiling)[0]) if floor <= ceiling else -1 for a, _, _, floor, ceiling in windows]
    wanted = pa.table([pa.array(c, t) for c, t in zip([*(list(x) for x in zip(*windows, strict=True)), place] if windows else [[]] * 6, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()], strict=True)], names=["anchor", "positive_id", "positive_score", "floor", "ceiling", "slot"])
    asked = spark.createDataFrame(wanted).filter("slot >= 0")
    answered = asked.join(lists.withColumn("suffixes", suffixes).select("anchor", "suffixes"), "anchor")
    answered = answered.select("anchor", "positive_id", "positive_score", F.posexplode(F.expr("filter(suffixes[slot], x -> x.score >= floor)")).alias("at", "e"))
    return answered.select("anchor", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("negative_id"), "positive_score", F.col("e.score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256, positives: int = 5, keep: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says which rows are anchors. A score is the inner product of two
    vectors whose numbers x became floor(scale x). An anchor's positives are the
    first rows of its label, its negatives those of other labels whose score is
    from ``low`` to ``high`` percent of the positive's; of these the first
    ``keep`` are returned for each positive. First: highest score, then smallest key.

    Keys and labels are whole numbers. Rows with a null key, label or vector or
    with a null or non-finite number take no part. Vectors of different length
    don't meet. Rows with the anchor's key are neither its positives nor its
    negatives; other repeated rows are rows of their own, and a repeated anchor
    gives its rows again. Positives without a window (negative score) or without
    negatives give none. Scores beyond 64 bits count as the limit. Other columns
    don't matter; an empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    v = F.col(quoted(vector))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    asked = F.coalesce(anchors, F.lit(False))
    rows = vectors.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(label)).cast("long").alias("label"), v.alias("v"), asked.alias("asked"), finite.alias("finite"))
    rows = rows.filter("key IS NOT NULL AND label IS NOT NULL AND finite")
    chosen = rows.filter("asked").groupBy("key", "label", "v").agg(F.count("*").alias("copies")).checkpoint()
    rows = rows.select("key", "label", "v")
    size = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("numbers")).first()
    blocks = max(1, -(-size.n // BLOCK_ANCHORS), -(-size.numbers // BLOCK_NUMBERS))
    while True:  # distinct anchors spread by hash: a block above the bound is rare, and more blocks mend it
        chosen = chosen.withColumn("block", F.pmod(F.xxhash64("key", "label", "v"), F.lit(blocks)))
        full = chosen.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("numbers")).filter(F.col("n") > 1).agg(F.max("n"), F.max("numbers")).first()
        if (full[0] or 0) <= 2 * BLOCK_ANCHORS and (full[1] or 0) <= 2 * BLOCK_NUMBERS:
            break
        blocks *= 2
    root = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for b in range(blocks):
        table = chosen.filter(F.col("block") == b).select("key", "label", "v", "copies").toArrow().sort_by("key")
        if not table.num_rows:
            continue
        found = block_negatives(rows, table, scale, positives, keep, low, high)
        names = spark.createDataFrame(pa.table([pa.array(range(table.num_rows), pa.int32()), table.column("key"), table.column("copies")], names=["anchor", "anchor_id", "copies"]))
        found = found.join(names, "anchor").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{root}/part={b}")
    spark.createDataFrame([], schema).write.parquet(f"{root}/part=-1")
    return spark.read.schema(schema).parquet(root).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
