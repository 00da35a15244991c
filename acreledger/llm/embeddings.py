"""Near-duplicate embeddings by an exact metric range join.

Unit vectors are points whose distance falls as their cosine grows, so a cosine
bound is a range bound r. Sampled pivots partition the points: each belongs to
the cell of its nearest pivot. A point of another cell can lie within r of a
point of cell i only if its distance to pivot i is at most 2 r more than to its
own pivot (twice the triangle inequality) and if it is within r of the plane
halfway between the two pivots; only then it is copied to cell i. Cells join
independently. A cell is dealt to blocks of bounded size, and pairs of blocks are
compared by matrix products; a pair of blocks returns link counts and a forest of
its links, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreledger.llm.common import prepare, quoted
from acreledger.llm.components import components

COSINE = 0.95
#: Points of a cell on average, points of a block, pivots at most (they are broadcast: 32 MB at 1,000 dimensions), rows of a tile.
CELL, BLOCK, MAX_PIVOTS, TILE = 8192, 8192, 4096, 512
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def cells_of(x: np.ndarray, pivots: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, cell, own) for the own cell of each point and the cells before it that it must be copied to."""
    square = np.maximum(2 - 2 * (x @ pivots.T), 0)
    home = square.argmin(axis=1)
    near = square[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[home]
    copy = np.sqrt(square) - np.sqrt(near)[:, None] <= 2 * r + SLACK
    copy &= square - near[:, None] <= 2 * apart * r + SLACK
    copy &= np.arange(len(pivots))[None, :] < home[:, None]  # a pair of two cells is met in the first of them
    point, cell = np.nonzero(copy)
    return np.r_[np.arange(len(x)), point], np.r_[home, cell], np.r_[np.ones(len(x), bool), np.zeros(len(point), bool)]


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of two sets of unit vectors have at least that cosine."""
    s = a @ b.T
    out = s >= cosine
    for i, j in np.argwhere(np.abs(s - cosine) < 1e-13):  # as a plain dot product says
        out[i, j] = math.fsum(a[i] * b[j]) >= cosine
    return out


def join_blocks(left: np.ndarray, right: np.ndarray | None, weight_left: np.ndarray, weight_right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each left and right point, weighted by how often the other occurs, and a label that linked points share.

    Without a right block the left one is joined to itself, a point not to itself.
    """
    alone = right is None
    n, other = len(left), left if alone else right
    counts_left, counts_right = np.zeros(n, dtype=np.int64), np.zeros(len(other), dtype=np.int64)
    label = np.arange(n if alone else n + len(other))
    base = 0 if alone else n
    for start in range(0, n, TILE):
        mask = linked(left[start : start + TILE], other, cosine)
        if alone:
            mask[np.arange(len(mask)), start + np.arange(len(mask))] = False
        if not mask.any():
            continue
        counts_left[start : start + TILE] += mask @ weight_right
        if not alone:
            counts_right += weight_left[start : start + TILE] @ mask
        i, j = np.nonzero(mask)
        i, j = i + start, j + base
        while True:
            least = np.minimum(label[i], label[j])
            if (label[i] == least).all() and (label[j] == least).all():
                break
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            label = label[label]
    return counts_left, counts_right, label


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Rows (key, n_links, component, kept), one for each input row.

    n_links: other rows whose vector has at least that cosine with this one, in
    double precision; component: the smallest key reachable by links, itself
    included; kept: whether that is the own key. Vectors that are null, empty,
    zero or hold null or non-finite numbers link with nothing; vectors of
    different length don't link. Repeated rows are rows of their own. Rows with a
    null key count as others; a component of null keys alone is null and kept.

    Equal vectors are one point with a weight, so copies aren't compared. The
    number of cells grows with the points; without structure (random directions)
    most points are copied to most cells, as any exact method must compare them.
    """
    spark = prepare(vectors.sparkSession)
    v = F.col("v")
    rows = vectors.select(F.col(quoted(key)).alias("key"), F.col(quoted(vector)).cast("array<double>").alias("v"))
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("point", F.when(fine, F.sha2(F.concat_ws(",", F.transform(v, lambda x: x.cast("string"))), 256)))
    points = rows.filter("point IS NOT NULL").groupBy("point").agg(F.first("v").alias("v"), F.count("*").alias("weight"), F.min("key").alias("low")).checkpoint()

    found = None
    for size, count in sorted((r.n, r.c) for r in points.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).collect()):
        part = links_of(points.filter(F.size("v") == size), count, cosine)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"), F.lit(True).alias("kept"))
    found = found.checkpoint()
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    named = points.select("point", "weight", "low").join(counts, "point", "left").join(components(found, "point", "label"), F.col("point") == F.col("node"), "left")
    named = named.select("point", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "low", F.coalesce("component", "point").alias("group"))
    least = named.groupBy("group").agg(F.min("low").alias("component"))
    result = rows.select("key", "point").join(named.join(least, "group").select("point", "n_links", "component"), "point", "left")
    own = F.when(F.col("point").isNull(), F.col("key")).otherwise(F.col("component"))
    return result.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component"), own.eqNullSafe(F.col("key")).alias("kept"))


def links_of(points: DataFrame, count: int, cosine: float) -> DataFrame:
    """(point, links, label): per block pair, the points with links, how many (weighted), and a point of the same forest."""
    spark = points.sparkSession
    r = math.sqrt(max(0.0, 2 - 2 * cosine))
    n = min(MAX_PIVOTS, max(1, -(-count // CELL)))
    chosen = np.array([row.v for row in points.orderBy("point").limit(n).select("v").collect()])
    pivots = spark.sparkContext.broadcast(unit(chosen))

    def deal(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            if len(pdf):
                x = unit(np.array(pdf["v"].tolist(), dtype=np.float64))
                for start in range(0, len(x), TILE):
                    at, cell, own = cells_of(x[start : start + TILE], pivots.value, r)
                    out = pdf.iloc[start + at][["point", "v", "weight"]].copy()
                    out["cell"], out["own"] = cell, own
                    yield out

    dealt = points.select("point", "v", "weight").mapInPandas(deal, "point string, v array<double>, weight long, cell int, own boolean")
    # a row for each cell: the driver deals a cell's points to blocks, at most MAX_PIVOTS rows
    sizes = {(s.cell, s.own): s.n for s in dealt.groupBy("cell", "own").agg(F.count("*").alias("n")).collect()}
    plan = [(cell, max(1, -(-sizes[cell, True] // BLOCK)), -(-sizes.get((cell, False), 0) // BLOCK)) for cell, own in sizes if own]
    blocks = spark.createDataFrame(plan, "cell int, own_blocks int, copy_blocks int")
    mine = F.pmod(F.xxhash64("point"), F.when(F.col("own"), F.col("own_blocks")).otherwise(F.greatest("copy_blocks", F.lit(1))))
    # unit (cell, i, j): block i of the cell's own points against own block j >= i, or against copied block j - own_blocks
    to_own = F.transform(F.sequence(F.lit(0), F.col("own_blocks") - 1), lambda i: F.struct(F.least(i, F.col("mine")).alias("i"), F.greatest(i, F.col("mine")).alias("j"), (i < F.col("mine")).alias("right")))
    to_copies = F.when(F.col("copy_blocks") > 0, F.transform(F.sequence(F.lit(0), F.greatest("copy_blocks", F.lit(1)) - 1), lambda j: F.struct(F.col("mine").alias("i"), (j + F.col("own_blocks")).alias("j"), F.lit(False).alias("right")))).otherwise(F.array().cast("array<struct<i:int,j:int,right:boolean>>"))
    from_copies = F.transform(F.sequence(F.lit(0), F.col("own_blocks") - 1), lambda i: F.struct(i.alias("i"), (F.col("mine") + F.col("own_blocks")).alias("j"), F.lit(True).alias("right")))
    units = dealt.join(F.broadcast(blocks), "cell").withColumn("mine", mine.cast("int"))
    units = units.withColumn("u", F.explode(F.when(F.col("own"), F.concat(to_own, to_copies)).otherwise(from_copies))).select("point", "v", "weight", "cell", "u.i", "u.j", "u.right")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        x, weight, right = unit(np.array(pdf["v"].tolist(), dtype=np.float64)), pdf["weight"].to_numpy(), pdf["right"].to_numpy(dtype=bool)
        names = pdf["point"].to_numpy()
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            counts, _, label = join_blocks(x, None, weight, weight, cosine)
            order = np.arange(len(x))
        else:
            order = np.r_[np.flatnonzero(~right), np.flatnonzero(right)]
            a, b, label = join_blocks(x[~right], x[right], weight[~right], weight[right], cosine)
            counts = np.r_[a, b]
        hit = counts > 0
        return pd.DataFrame({"point": names[order][hit], "links": counts[hit], "label": names[order][label[hit]]})

    return units.groupBy("cell", "i", "j").applyInPandas(join, "point string, links long, label string")
