"""SimHash near duplicates, found by pigeonring filtering.

A fingerprint is four segments of 16 bits on a ring. If two fingerprints differ
in at most t bits, then some run of consecutive segments, started at a suitable
segment, keeps every prefix of it within its share of t: after one segment at
most t/4 differing bits, after two 2t/4, and so on. For t = 3 the budgets are
0, 1, 2, 3. The first two segments of such a run make a join key of 32 bits: one
side emits its own key, the other also the 16 keys with one bit of the second
segment turned. The budgets of three and four segments are checked in the join,
before the Hamming check of the whole, so only links leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreledger.llm.common import ASCII_LOWER, fields, free_name, map_column, quoted
from acreledger.llm.components import components

SEGMENTS, BITS = 4, 16
PIECE = 4096
#: Winners that are repeated rows are broadcast up to this number of (key, digest) rows, else joined by a shuffle.
BROADCAST_ROWS = 10_000


def fingerprint_of(text: str | None, size: int) -> int:
    """The fingerprint as a signed long; shingles are hashed a few thousand at a time."""
    import re

    import numpy as np
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode("utf-8", "replace").translate(ASCII_LOWER)) if text else []
    if not words:
        return 0
    size = min(size, len(words))
    total, sums = len(words) - size + 1, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_digest
    for start in range(0, total, PIECE):
        part = words[start : start + PIECE + size - 1]
        hashes = b"".join([digest(s, 42) for s in map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False))])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        sums += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", result: str = "simhash", shingle_words: int = 3) -> DataFrame:
    """Append the 64-bit SimHash of each whole text as a signed long.

    A-Z are lower-cased; words are what stands between spaces, tabs and line
    ends; shingles count as often as they occur and are hashed with XXH64, seed
    42. A bit is set if more than half of the hashes have it. A text of fewer
    words is one shingle; a null text or one without words has fingerprint zero.
    """

    def job():
        return lambda texts: [(fingerprint_of(t, shingle_words),) for t in texts]

    return map_column(docs, text, fields(f"{quoted(result)} long"), job)


def segment(value: Column, at: int) -> Column:
    """The segment at a place of the ring."""
    return F.shiftrightunsigned(value, BITS * (at % SEGMENTS)).bitwiseAND((1 << BITS) - 1)


def links(prints: DataFrame, name: str, max_bits: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints that differ in at most ``max_bits`` (0 to 3) bits.

    Each fingerprint gives 4 rows to one side of the join and 68 to the other,
    whatever the data; a key that many share is split by AQE's skew join. The join
    is a sort-merge join by hint: Spark sizes both sides by the fingerprints before
    they are exploded and would broadcast 68 times what it reckons. A pair is kept
    at the first run of the ring that satisfies the budgets.
    """
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError(f"at most {SEGMENTS - 1} bits")
    shares = [max_bits * (n + 1) // SEGMENTS for n in range(SEGMENTS)]
    one = prints.select(F.col(quoted(name)).alias("f")).filter("f IS NOT NULL").distinct()

    def keyed(side: str, turns: list[int]) -> DataFrame:
        f = F.col("f")
        starts = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), segment(f, i).alias("own"), segment(f, i + 1).alias("next")) for i in range(SEGMENTS))))
        keys = one.select(f.alias(side), starts.alias("s")).select(side, F.col("s.at").alias("at"), F.col("s.own").alias("own"), F.col("s.next").alias("next"))
        # start, first and second segment in one long
        key = F.shiftleft(F.col("at").cast("long"), 2 * BITS) + F.shiftleft(F.col("own"), BITS)
        if len(turns) == 1:
            return keys.select(side, (key + F.col("next")).alias("key"))
        turn = F.explode(F.array(*(F.lit(t).cast("long") for t in turns)))
        return keys.select(side, key.alias("base"), "next", turn.alias("turn")).select(side, (F.col("base") + F.col("next").bitwiseXOR(F.col("turn"))).alias("key"))

    turned = [0] + ([1 << i for i in range(BITS)] if shares[1] else [])
    a, b = keyed("a", [0]), keyed("b", turned)
    apart = F.col("a").bitwiseXOR(F.col("b"))
    start = F.shiftright("key", 2 * BITS)

    def within(at: int) -> Column:
        """Whether the run that starts here keeps to its budgets."""
        used, good = None, F.lit(True)
        for n in range(SEGMENTS):
            step = F.bit_count(segment(apart, at + n))
            used = step if used is None else used + step
            good = good & (used <= shares[n])
        return good

    first = F.lit(None).cast("long")
    for at in reversed(range(SEGMENTS)):
        first = F.when(within(at), F.lit(at).cast("long")).otherwise(first)
    match = (F.col("x.key") == F.col("y.key")) & (F.col("a") < F.col("b")) & (F.bit_count(apart) <= max_bits)
    pairs = a.alias("x").hint("merge").join(b.alias("y"), match).select("a", "b", F.col("x.key").alias("key"))
    # the join's larger side turns one bit of the second segment: with a and b in either role each run is met
    return pairs.filter(start == first).select("a", "b")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """Rows (key, simhash, component), one for each row of ``docs``.

    component: the smallest key reachable through links of fingerprints that
    differ in at most ``max_bits`` bits, itself included; rows of equal
    fingerprints are linked. Null keys have a row but never name a component of a
    group with other keys; a group of null keys alone has component null. Empty
    input gives no rows. Links join distinct fingerprints, so a group of copies,
    however large, is one node.
    """
    own = fingerprints(docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")), "text", "simhash", shingle_words).drop("text").checkpoint()
    named = own.groupBy("simhash").agg(F.min("key").alias("low"))
    linked = components(links(named, "simhash", max_bits))
    named = named.join(linked, F.col("simhash") == F.col("node"), "left").select("simhash", "low", F.coalesce("component", "simhash").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("least"))
    grouped = named.join(lows, "component").select("simhash", F.col("least").alias("component"))
    return own.join(grouped, "simhash").select(F.col("key").alias(key), "simhash", "component")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """The input rows with one row of each SimHash class left, all columns kept.

    The row with the smallest key stays (nulls last; then the smallest text
    digest); of rows that repeat entirely one stays. Decisions travel as (key,
    digest), not with the texts, and rows are found again by them; only repeats
    of a winner are compared as whole rows.
    """
    k, t = F.col(quoted(key)), F.sha2(F.coalesce(F.col(quoted(text)), F.lit("")), 256)
    missing = F.col(quoted(text)).isNull()
    inner = docs.select(k.alias("key"), F.struct(k.isNull().alias("nokey"), k.alias("key"), missing.alias("missing"), t.alias("digest")).alias("rank"), F.col(quoted(text)).alias("text"))
    own = fingerprints(inner, "text", "simhash", shingle_words).drop("text", "key").checkpoint()
    counted = own.groupBy("simhash", "rank").agg(F.count("*").alias("n"))
    heads = counted.groupBy("simhash").agg(F.min("rank").alias("rank"))
    linked = components(links(heads, "simhash", max_bits))
    group = F.coalesce("component", "simhash")
    winners = heads.join(linked, F.col("simhash") == F.col("node"), "left").groupBy(group.alias("component")).agg(F.min("rank").alias("rank"))
    winners = winners.join(counted.groupBy("rank").agg(F.sum("n").alias("n")), "rank").select("rank.*", "n").checkpoint()

    row, mark = free_name(docs, "row_"), free_name(docs, "mark_")
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(row), F.struct(k.isNull().alias("nokey"), k.alias("key"), missing.alias("missing"), t.alias("digest")).alias(mark))

    def kept(of: DataFrame) -> DataFrame:
        same = (F.col(f"{mark}.digest") == F.col("digest")) & F.col(f"{mark}.key").eqNullSafe(F.col("key")) & (F.col(f"{mark}.missing") == F.col("missing"))
        return whole.join(of, same, "left_semi")

    once = kept(winners.filter("n = 1")).select(f"{row}.*")
    repeats = winners.filter("n > 1")
    if repeats.isEmpty():
        return once
    again = kept(F.broadcast(repeats) if repeats.count() <= BROADCAST_ROWS else repeats)
    names = [F.col(f"r.{quoted(c)}") for c in docs.columns]
    return once.unionAll(again.groupBy(mark).agg(F.min(row).alias("r")).select(*names))
