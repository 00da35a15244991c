"""A mixture of sources by target weights, from fixed-length blocks.

The words of a source stand in one long row, text after text in a hashed order,
cut into blocks of a fixed number of words. The mixture is a row of slots, some
for each output shard. Every slot draws its source, so the counts of a shard are
multinomial; slots drawn beyond a source's share go to the sources that are
short, in order. The n-th slot of a source takes the block that a pseudorandom
permutation of its block indexes gives for n, another permutation for each pass over
the source. Slots and blocks then meet in a join by index. DataFrame functions
alone do the work; whole numbers decide everything, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreledger.llm.common import prepare, quoted
from acreledger.sources.storage import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of a shard at least (the root of all slots for large mixtures), times that a source may be passed over.
BLOCK, SHARD_SLOTS, PASSES = 64, 4096, 3
#: Equal rows that are laid out as one unit, pieces of a table of intervals, rounds of the permutation, slots of a task.
RUN, BUCKETS, ROUNDS, TASK_SLOTS = 1024, 1024, 12, 1 << 20
#: For hashing whole numbers: a prime just below 2^31 and numbers below it.
PRIME, FACTOR, CONSTANT = 2_147_483_647, 1_103_515_245, 1_640_531_527


def hashed(x: str, salt: str) -> str:
    """SQL of a whole number below PRIME: a cubic polynomial of x and salt modulo PRIME. No step leaves 64 bits."""
    y = f"(({x}) % {PRIME}L + ({x}) div {PRIME}L * 31L + ({salt})) % {PRIME}L"
    return f"((({y}) * ({y}) % {PRIME}L) * ({y}) % {PRIME}L + {FACTOR}L * ({y}) + {CONSTANT}L) % {PRIME}L"


def wide(x: str, salt: int, below: str) -> str:
    """SQL of a hashed whole number below a bound that may exceed PRIME."""
    return f"(({hashed(x, f'{salt}L')}) * 2147483648L + {hashed(x, f'{salt + 7}L')}) % {below}"


def permuted(rows: DataFrame, x: str, size: str, key: str) -> DataFrame:
    """Replace column x, 0 to size - 1, by its place in a pseudorandom permutation, one for each key below PRIME.

    Swap or not: in each round x and its partner (a round number less x, modulo
    size) change places or not, as a bit of the larger one's hash says. Partners
    are mutual, so every round is a permutation whatever the size. A round is three
    projections, which Spark leaves apart, so that each value is computed once, in generated code.
    """
    others = [c for c in rows.columns if c != x]
    for r in range(1, ROUNDS + 1):
        turn = f"({key} * 31L + {r * r * CONSTANT}L) % {PRIME}L * 2147483648L + ({key} + {r * FACTOR}L) % {PRIME}L"
        rows = rows.selectExpr(*others, x, f"pmod({turn} - {x}, {size}) AS partner_")
        y = f"(greatest({x}, partner_) % {PRIME}L + greatest({x}, partner_) div {PRIME}L * 31L + {key} + {r * 7919}L) % {PRIME}L"
        rows = rows.selectExpr(*others, x, "partner_", f"{y} AS y_")
        bit = f"(y_ * y_ % {PRIME}L * y_ + {FACTOR}L * y_) % {PRIME}L div 65536L % 2L"
        rows = rows.selectExpr(*others, f"if({bit} = 1L, partner_, {x}) AS {x}")
    return rows


def located(points: DataFrame, value: str, intervals: DataFrame, low: str, high: str, total: int, how: str) -> DataFrame:
    """Join each point to the interval [low, high) that holds its value. Intervals are disjoint and end at ``total``.

    Points and intervals meet on the pieces of a grid, so it is an equi-join.
    """
    width = max(1, -(-total // BUCKETS))
    spread = intervals.filter(f"{high} > {low}").withColumn("bucket_", F.explode(F.expr(f"sequence({low} div {width}L, ({high} - 1) div {width}L)")))
    joined = points.withColumn("bucket_", F.expr(f"{value} div {width}L"))
    inside = (joined["bucket_"] == spread["bucket_"]) & (joined[value] >= spread[low]) & (joined[value] < spread[high])
    return joined.join(spread, inside, how).drop("bucket_")


def targets(sizes: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """Rows (place, source, weight, size, rows, target, blocks, quota, quota_from) of (source, size, rows).

    Sources in code-point order, null last, weigh 1, 2, 3 and so on over again and
    share the sum of the sizes; a target above ``passes`` times its source's size
    is cut there and the excess shared by weight until none is above: with the
    sources in the order of that limit over weight, a source is at its limit if the
    rest, shared by weight, would reach it. quota: blocks that come nearest to the target.
    One row a source: the windows order sources, not documents.
    """
    sources = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long"))
    sources = sources.withColumn("weight", (F.col("place") - 1) % 3 + 1).withColumn("limit", F.col("size") * passes)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    everything = Window.partitionBy()
    big = "decimal(38,0)"
    sources = sources.withColumn("total", F.sum("size").over(everything))
    sources = sources.withColumn("rest", F.col("total") - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = sources.withColumn("shares", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    sources = sources.withColumn("full", F.col("limit").cast(big) * F.col("shares") <= F.col("rest").cast(big) * F.col("weight"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0))
    shared = left.cast("double") * F.col("weight") / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    sources = sources.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared))
    sources = sources.withColumn("blocks", F.expr(f"(size + {block - 1}) div {block}L"))
    near = F.floor(F.col("target") * F.col("blocks") / F.col("size") + 0.5).cast("long")
    sources = sources.withColumn("quota", F.when(F.col("size") > 0, F.least(near, F.col("blocks") * passes)).otherwise(F.lit(0).cast("long")))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("quota_from", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    return sources.select("place", "source", "weight", "size", "rows", "target", "blocks", "quota", "quota_from")


def lay_out(docs: DataFrame, key: str, text: str, source: str, block: int, passes: int) -> tuple[DataFrame, DataFrame]:
    """(sources, laid): the table of targets, and a row (place, key, digest, size, copy, at) for each document.

    at: words of its source before it. Sources are cut into the root of their
    number of rows, by hash, so neither the rows of a part nor the parts are many;
    equal rows are one row with a count until they are numbered, RUN at a time.
    """
    size = F.coalesce(F.regexp_count(F.col(quoted(text)), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select(F.col(quoted(source)).cast("string").alias("source"), F.col(quoted(key)).alias("key"), F.coalesce(F.md5(F.col(quoted(text)).cast("binary")), F.lit("")).alias("digest"), size.alias("size"))
    units = staged(slim.groupBy("source", "key", "digest", "size").agg(F.count("*").alias("copies")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("rows"))
    sources = staged(targets(sizes, block, passes).coalesce(1), "sources")
    named = sources.select("place", F.col("source").alias("named"), F.ceil(F.sqrt("rows")).cast("long").alias("parts"))
    runs = units.join(named, F.col("source").eqNullSafe(F.col("named"))).withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN}L)")))
    runs = runs.withColumn("many", F.expr(f"least({RUN}L, copies - run * {RUN}L)")).withColumn("words", F.col("many") * F.col("size"))
    runs = runs.withColumn("name", F.expr("md5(concat_ws('|', key, digest, run))")).withColumn("part", F.expr("conv(substr(name, 1, 8), 16, 10)").cast("long") % F.col("parts"))
    earlier = [Window.unboundedPreceding, -1]
    parts = runs.groupBy("place", "part").agg(F.sum("words").alias("words"))
    first = F.coalesce(F.sum("words").over(Window.partitionBy("place").orderBy("part").rowsBetween(*earlier)), F.lit(0))
    within = F.coalesce(F.sum("words").over(Window.partitionBy("place", "part").orderBy("name", "key", "digest", "run").rowsBetween(*earlier)), F.lit(0))
    runs = runs.withColumn("within", within).join(parts.select("place", "part", first.alias("first")), ["place", "part"])
    each = runs.withColumn("c", F.explode(F.expr("sequence(0L, many - 1)")))
    laid = each.select("place", "key", "digest", "size", F.expr(f"run * {RUN}L + c").alias("copy"), F.expr("first + within + c * size").alias("at"))
    return sources, staged(laid, "laid")


def draw_slots(sources: DataFrame, seed: int) -> DataFrame:
    """Rows (shard, slot, place, pass, block): which block of which source each slot of each output shard holds."""
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shard_slots = max(SHARD_SLOTS, int(n**0.5) + 1)
    slots = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, -(-n // TASK_SLOTS)))
    slots = slots.select("id", F.expr(f"id div {shard_slots}L").alias("shard"), F.expr(wide("id", seed, f"{max(n, 1)}L")).alias("draw"))
    shares = sources.select("place", "quota_from", (F.col("quota_from") + F.col("quota")).alias("quota_to"))
    drawn = located(slots, "draw", shares, "quota_from", "quota_to", n, "inner").select("id", "shard", "place")
    counts = drawn.groupBy("shard", "place").agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")

    # sources drawn more often than their quota, and less often
    totals = sources.join(counts.groupBy("place").agg(F.sum("n").alias("n")), "place", "left").na.fill(0, ["n"])
    totals = totals.withColumn("surplus", F.greatest(F.col("n") - F.col("quota"), F.lit(0))).withColumn("lack", F.greatest(F.col("quota") - F.col("n"), F.lit(0)))
    earlier = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("surplus_from", F.coalesce(F.sum("surplus").over(earlier), F.lit(0))).withColumn("lack_from", F.coalesce(F.sum("lack").over(earlier), F.lit(0)))
    totals = staged(totals.select("place", "blocks", "quota", "n", "surplus", "surplus_from", "lack_from", (F.col("lack_from") + F.col("lack")).alias("lack_to")).coalesce(1), "totals")
    over = totals.agg(F.coalesce(F.sum("surplus"), F.lit(0))).first()[0]

    nth = F.row_number().over(Window.partitionBy("shard", "place").orderBy("id")) - 1
    numbered = drawn.withColumn("nth", nth.cast("long")).join(counts.select("shard", "place", "first"), ["shard", "place"])
    numbered = numbered.join(totals.select("place", "quota", "surplus_from"), "place").withColumn("j", F.col("first") + F.col("nth"))
    numbered = numbered.withColumn("over", F.when(F.col("j") >= F.col("quota"), F.col("surplus_from") + F.col("j") - F.col("quota")))
    takers = totals.select(F.col("place").alias("taker"), F.col("n").alias("has"), "lack_from", "lack_to")
    moved = located(numbered, "over", takers, "lack_from", "lack_to", over, "left")
    moved = moved.select("id", "shard", F.coalesce("taker", "place").alias("place"), F.coalesce(F.expr("has + over - lack_from"), F.col("j")).alias("j"))
    moved = moved.join(totals.select("place", "blocks"), "place").withColumn("pass", F.expr("j div blocks"))
    moved = moved.withColumn("key", F.expr(hashed(f"place * {PASSES + 1}L + pass", f"{seed + 99}L"))).withColumn("block", F.expr("j % blocks"))
    placed = permuted(moved.select("id", "shard", "place", "pass", "blocks", "key", "block"), "block", "blocks", "key")
    # written, since a filter that a join puts on the block would be pushed through the rounds, doubling at each
    return staged(placed.select("shard", F.expr(f"id % {shard_slots}L").alias("slot"), "place", F.col("pass").cast("int").alias("pass"), "block"), "slots")


def pieces(laid: DataFrame, block: int) -> DataFrame:
    """Rows (place, block, key, digest, copy, at, first_word, n_words): the part of each document in each block it reaches into."""
    reach = F.explode(F.expr(f"sequence(at div {block}L, (at + size - 1) div {block}L)"))
    cut = laid.filter("size > 0").withColumn("block", reach).withColumn("begin", F.expr(f"block * {block}L"))
    return cut.select("place", "block", "key", "digest", "size", "copy", F.expr("greatest(at - begin, 0L)").alias("at"), F.expr("greatest(begin - at, 0L)").alias("first_word"), F.expr(f"least(at + size, begin + {block}L) - greatest(at, begin)").alias("n_words"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, passes: int = PASSES, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, documents, mixture).

    sources: (place, source, weight, size, rows, target, blocks, quota, ...). documents:
    (place, key, digest, size, copy, at), one row for each input row; place names the
    source, copy numbers equal rows. mixture: (shard, slot, place, pass, block, key,
    digest, copy, at, first_word, n_words), the words of documents in each slot
    of each shard, in the order of ``at``; ``texts`` spells them out.

    A word is a run of signs other than blank, tab and line ends. Null texts have no words, a
    null source is a source (the last), null keys are keys like any other,
    repeated rows are rows of their own. A source takes ``quota`` blocks, hence its
    target but for half a block and what its last block lacks; no document is taken
    more than ``passes`` times. Other columns don't matter; an empty table gives empty frames.
    """
    prepare(docs.sparkSession)
    sources, laid = lay_out(docs, key, text, source, block, passes)
    mixture = draw_slots(sources, seed).join(pieces(laid, block), ["place", "block"])
    return sources, laid, mixture.select("shard", "slot", "place", "pass", "block", "key", "digest", "size", "copy", "at", "first_word", "n_words")


def texts(docs: DataFrame, mixture: DataFrame, sources: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (shard, slot, source, text): the words of every slot, blank between words."""
    whole = docs.select(F.col(quoted(source)).cast("string").alias("from_"), F.col(quoted(key)).alias("key_"), F.md5(F.col(quoted(text)).cast("binary")).alias("digest"), F.col(quoted(text)).alias("text")).dropDuplicates(["from_", "key_", "digest"])
    named = mixture.join(sources.select("place", "source"), "place")
    met = named.join(whole, (named["digest"] == whole["digest"]) & named["key"].eqNullSafe(whole["key_"]) & named["source"].eqNullSafe(whole["from_"]))
    words = F.expr(f"slice(regexp_extract_all(text, '{WORD}', 0), cast(first_word + 1 AS int), cast(n_words AS int))".replace("\\", "\\\\"))
    spelled = met.select("shard", "slot", "source", "at", F.array_join(words, " ").alias("words"))
    # a slot holds at most a block of words
    joined = spelled.groupBy("shard", "slot", "source").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
    return joined.select("shard", "slot", "source", F.array_join("all.words", " ").alias("text"))


def taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, passes: int = PASSES, seed: int = 1) -> DataFrame:
    """Rows (key, size, source_size, target, taken), one for each input row: the words of it that the mixture holds, repeats counted."""
    sources, laid, mixture = mix(docs, key, text, source, block, passes, seed)
    columns = ["place", "key", "digest", "size", "copy"]
    rows = laid.select(*columns, F.lit(0).cast("long").alias("n_words")).unionAll(mixture.select(*columns, "n_words"))
    sums = rows.groupBy(*columns).agg(F.sum("n_words").alias("taken"))
    found = sums.join(sources.select("place", F.col("size").alias("source_size"), "target"), "place")
    return found.select(F.col("key").alias(key), "size", "source_size", "target", "taken")
