"""Balanced shards by vector bin packing.

Each group of equal texts is a vector of bytes, tokens and rows. Groups are placed
one after another, the largest first, each in the shard where the dot product of
its vector with what the shard still lacks of an equal share is highest; moves and
swaps of units then lower what is left uneven in all three. Groups larger than a
small share are cut into pieces by a hash of the key, since no shard could take a
group of a third of all rows; copies of a row that overfill a piece are dealt
round the pieces one by one. Small groups travel in buckets by a hash of their
text. So what is packed in order is a bounded number of units, whatever the number
of documents, and everything else is done where the rows are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreledger.llm.common import free_name, prepare, quoted

LAW = "bytes"
#: A group above 1 / (shards * SHARES) of all bytes, tokens or rows is cut; smaller ones go to BUCKETS buckets.
SHARES, BUCKETS = 64, 1 << 14
#: Rows that one task numbers.
CHUNK_ROWS = 100_000
#: A piece is overfull beyond FULL times its even part; a key is dealt out where its copies exceed HOT of that part.
FULL, HOT = 1.25, 0.25
#: Copies that are written out at once.
COPIES = 4_096
#: What a dimension's unevenness weighs against the others (bytes, the law, first); units of a shard and shards that a step looks at; where it ends.
WEIGHTS, LOOKED_AT, ENDS, EVEN = (100.0, 1.0, 1.0), 1_024, 8, 1e-4


def pack(units: list[tuple[str, tuple[float, ...]]], shards: int) -> dict[str, int]:
    """Shard of each unit. Units are placed by falling size, ties by name and by shard; then :func:`even_out` mends the rest."""
    if not units:
        return {}
    dims = range(len(units[0][1]))
    total = [sum(u[1][d] for u in units) or 1.0 for d in dims]
    lacks = [[1.0 / shards] * len(total) for _ in range(shards)]
    share = {name: [size[d] / total[d] for d in dims] for name, size in units}
    where: dict[str, int] = {}
    held: list[list[str]] = [[] for _ in range(shards)]
    for name in sorted(share, key=lambda n: (-max(share[n]), n)):
        v = share[name]
        best = max(range(shards), key=lambda s: (sum(x * y for x, y in zip(v, lacks[s], strict=True)), -s))
        where[name] = best
        held[best].append(name)
        lacks[best] = [x - y for x, y in zip(lacks[best], v, strict=True)]
    even_out(where, held, lacks, share, shards)
    return where


def even_out(where: dict[str, int], held: list[list[str]], lacks: list[list[float]], share: dict[str, list[float]], shards: int) -> None:
    """Move or swap units between two shards as long as that lowers the weighted squares of what shards lack.

    Shards furthest apart in a dimension come first, by its weight; of every pair
    of their units (one may be none) the one that leaves the two most alike in all
    dimensions changes places.
    """
    dims = range(len(lacks[0]))
    weights = np.array([(*WEIGHTS, *[1.0] * len(lacks[0]))[d] for d in dims])
    lack = np.array(lacks)
    none = np.zeros((1, len(lacks[0])))

    def sample(s: int) -> tuple[list[str], np.ndarray]:
        names = sorted(held[s], key=lambda n: (share[n], n))
        names = names[:: -(-len(names) // LOOKED_AT) or 1]
        return names, np.concatenate([none, np.array([share[n] for n in names]).reshape(-1, len(lacks[0]))])

    stuck: set[tuple[int, int]] = set()
    for _ in range(64 * shards):
        for low, high in furthest(lack, weights, stuck):
            (from_high, a), (from_low, b) = sample(high), sample(low)
            gap = lack[low] - lack[high]
            gain = np.zeros((len(a), len(b)))
            for d in dims:
                x = a[:, d, None] - b[None, :, d]
                gain += weights[d] * x * (gap[d] - x)
            i, j = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[i, j] <= 1e-15:
                stuck.add((low, high))
                continue
            for n, names, old, new in ((i, from_high, high, low), (j, from_low, low, high)):
                if n:
                    held[old].remove(names[n - 1])
                    held[new].append(names[n - 1])
                    where[names[n - 1]] = new
            lack[low] -= a[i] - b[j]
            lack[high] += a[i] - b[j]
            stuck = {s for s in stuck if not {low, high} & set(s)}
            break
        else:
            return


def furthest(lack: np.ndarray, weights: np.ndarray, stuck: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of shards that differ, the weightiest difference first: of each dimension those of its ENDS emptiest and fullest."""
    pairs = {}
    for d in range(lack.shape[1]):
        order = [int(s) for s in np.argsort(-lack[:, d], kind="stable")]
        for low in order[:ENDS]:
            for high in order[-ENDS:]:
                gap = lack[low, d] - lack[high, d]
                if gap * len(lack) >= EVEN and (low, high) not in stuck:
                    pairs[low, high] = max(pairs.get((low, high), 0.0), weights[d] * gap * gap)
    return sorted(pairs, key=lambda s: (-pairs[s], s))


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Append size, text_crc32, law, shard and slot to every row.

    size: UTF-8 bytes of the text plus one; text_crc32: of the UTF-8 bytes (null
    counts as empty, but is a group of its own); law: ``bytes``; slot: place in
    the shard, gapless from 0, by a hash of key and text, then key. Null keys are
    keys like any other. Repeated rows are rows of their own; copies of a key and
    text that overfill a piece are folded to one row with a count, and written
    out again with the place among the copies, which deals them round the pieces and
    numbering tasks. Input columns named like a result are replaced. The number of
    packed units is bounded by SHARES and BUCKETS.
    """
    spark = prepare(docs.sparkSession)
    results = ("size", "text_crc32", "law", "shard", "slot")
    row = docs.select(*(F.col(quoted(c)) for c in docs.columns if c.lower() not in results))
    k, t = F.col(quoted(key)), F.col(quoted(text))
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1
    tokens = F.coalesce(F.size(F.split(F.trim(t), r"\s+")), F.lit(0)).cast("long")
    digest = F.coalesce(F.sha2(t, 256), F.lit("null"))

    slim = docs.select(k.alias("key"), size.alias("bytes"), tokens.alias("tokens"), digest.alias("digest"))
    groups = slim.groupBy("digest").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).checkpoint()
    totals = groups.agg(*(F.sum(c).alias(c) for c in ("bytes", "tokens", "rows"))).first()
    if totals["rows"] is None:
        return row.select("*", size.alias("size"), F.lit(0).cast("long").alias("text_crc32"), F.lit(LAW).alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cuts = F.ceil(F.greatest(*(F.col(c) * (shards * SHARES) / F.lit(max(1, totals[c])) for c in ("bytes", "tokens", "rows"))))
    # at most 3 * shards * SHARES groups are larger than that share of some dimension
    large = groups.filter("rows > 1").withColumn("pieces", cuts).filter("pieces > 1").select("digest", "pieces").checkpoint()

    sums = [F.sum(c).alias(c) for c in ("bytes", "tokens", "rows")]
    bucket = F.concat(F.lit("b"), F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)).cast("string"))
    small = groups.join(F.broadcast(large), "digest", "left_anti").groupBy(bucket.alias("unit")).agg(*sums)

    def piece(of: str, pieces: str, by: Column, nth: Column) -> Column:
        return F.concat_ws(":", F.col(of), F.pmod(F.pmod(F.xxhash64(by), F.col(pieces)) + nth, F.col(pieces)).cast("string"))

    names = {n: free_name(docs, n + "_") for n in ("digest", "pieces", "unit", "chunk", "first", "copies", "nth", "of", "who")}
    d, p, nth, copies, chunk, first = (names[n] for n in ("digest", "pieces", "nth", "copies", "chunk", "first"))
    whole = row.withColumn("size", size).withColumn("text_crc32", F.crc32(F.coalesce(t, F.lit("")).cast("binary"))).withColumn("law", F.lit(LAW)).withColumn(d, digest)
    whole = whole.join(F.broadcast(large.select(F.col("digest").alias(d), F.col("pieces").alias(p))), d, "left")

    by_key = slim.withColumn("rows", F.lit(1)).join(F.broadcast(large), "digest").withColumn("unit", piece("digest", "pieces", F.col("key"), F.lit(0)))
    cut = by_key.groupBy("unit", "digest", "pieces").agg(*sums).checkpoint()
    per_group = cut.groupBy("digest").agg((F.sum("rows") / F.first("pieces")).alias("part"))
    overfull = cut.join(F.broadcast(per_group), "digest").filter((F.col("rows") > FULL * F.col("part")) & (F.col("rows") > 1)).select("unit", "part").checkpoint()
    hot = None
    if not overfull.isEmpty():
        # keys with so many copies are at most pieces / HOT of a group
        counts = by_key.join(F.broadcast(overfull), "unit").groupBy("digest", "key", "part").agg(F.count("*").alias("n"))
        hot = counts.filter((F.col("n") > 1) & (F.col("n") > HOT * F.col("part"))).select(F.col("digest").alias(names["of"]), F.col("key").alias(names["who"])).checkpoint()
    if hot is None or hot.isEmpty():
        whole = whole.withColumn(nth, F.lit(0).cast("long"))
    else:
        whole = deal(whole, hot, (F.col(d) == F.col(names["of"])) & k.eqNullSafe(F.col(names["who"])), nth, copies)
        cut = whole.filter(F.col(p).isNotNull()).groupBy(piece(d, p, k, F.col(nth)).alias("unit")).agg(
            F.sum("size").alias("bytes"), F.sum(tokens).alias("tokens"), F.count("*").alias("rows"))
    units = [(u.unit, (float(u.bytes), float(u.tokens), float(u.rows))) for u in small.unionAll(cut.select(small.columns)).collect()]
    placed = spark.createDataFrame(list(pack(units, shards).items()), "unit string, shard int")

    chunks = max(1, -(-totals["rows"] // (shards * CHUNK_ROWS)))
    whole = whole.withColumn(names["unit"], F.when(F.col(p).isNotNull(), piece(d, p, k, F.col(nth))).otherwise(F.concat(F.lit("b"), F.pmod(F.xxhash64(d), F.lit(BUCKETS)).cast("string"))))
    whole = whole.join(F.broadcast(placed.withColumnRenamed("unit", names["unit"])), names["unit"])
    whole = whole.withColumn(chunk, F.pmod(F.pmod(F.xxhash64(k, F.col(d)), F.lit(chunks)) + F.col(nth), F.lit(chunks)).cast("int"))
    counted = whole.groupBy("shard", chunk).agg(F.count("*").alias("n"))
    offsets = counted.select("shard", chunk, F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(first))
    numbered = whole.withColumn("slot", F.row_number().over(Window.partitionBy("shard", chunk).orderBy(k, F.col(d), F.col(nth))))
    numbered = numbered.join(offsets, ["shard", chunk])
    return numbered.select(*(F.col(quoted(c)) for c in row.columns), "size", "text_crc32", "law", "shard", (F.col("slot") - 1 + F.col(first)).cast("long").alias("slot"))


def deal(rows: DataFrame, hot: DataFrame, same: Column, nth: str, copies: str) -> DataFrame:
    """Append a place ``nth`` to every row: 0, but for rows of the hot keys their place among equal rows, from a hash of the row.

    Equal rows are folded to one with a count, so the places don't hang on the
    order in which tasks see the rows, and then written out again by many tasks.
    """
    every = [F.col(quoted(c)) for c in rows.columns]
    rest = rows.join(F.broadcast(hot), same, "left_anti").withColumn(nth, F.lit(0).cast("long"))
    folded = rows.join(F.broadcast(hot), same, "left_semi").groupBy(*every).agg(F.count("*").alias(copies)).checkpoint()
    first = F.pmod(F.xxhash64(F.to_json(F.struct(*every))), F.lit(1 << 20))
    runs = folded.withColumn(nth, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(COPIES).cast("long"))))
    runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), first, F.col(nth))
    last = F.least(F.col(nth) + COPIES, F.col(copies)) - 1
    again = runs.withColumn(nth, F.explode(F.sequence(F.col(nth), last)))
    return rest.unionByName(again.select(*every, (first + F.col(nth)).alias(nth)))
