"""Phrase collocations from stripes.

A stripe is a counter of next words, keyed by the words before them. Tasks build
stripes of their texts (the empty prefix and all prefixes of two words and more),
stripes of one prefix are merged element by element, and everything is read off
the merged ones: the entries of a stripe are the counts of the prefix with one
word more, its total is the count of the prefix, the stripe of the empty prefix
holds the words, and the largest entries that a phrase is the beginning or the
end of say whether a longer phrase subsumes it.

No stripe is gathered whole: the empty prefix and prefixes that are frequent in a
sample are cut into parts by a hash of the next word, and parts travel in bundles
by bucket. The sample decides nothing but the numbers of parts and buckets.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreledger.llm.common import prepare, quoted, release
from acreledger.sources.storage import staged

#: Letters A-Z in lower case; every sign that ends a piece becomes a full stop, which no word holds.
SIGNS = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b"." * 9)
#: Word positions after which a task hands on its stripes; rows of an output batch; bytes that are split at once.
POSITIONS, ROWS, SLICE = 4_000_000, 1000, 1 << 20
#: Entries of a bucket, about; buckets of the sample and at least; an odd factor for hashing.
BUCKET, SAMPLE_BUCKETS, FACTOR = 400_000, 16, 0x9E3779B97F4A7C15
#: Parts of the empty prefix; documents of the sample; a prefix above 1/HOT of the sample's entries is cut.
PARTS, SAMPLE_ROWS, HOT = 4096, 2000, 1024
GAP, STOP = re.compile(rb"[ \t.]"), pa.array([b"."], pa.binary())
STRIPES = "lang string, prefix string, total long, size long, next array<string>, n array<long>"
ZSTD, UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def split(text: str) -> Iterator[pa.Array]:
    """Words in order, with a full stop where a piece ends, slice by slice of a long text."""
    signs = text.encode().translate(SIGNS)
    start = 0
    while start < len(signs):
        gap = GAP.search(signs, start + SLICE)
        end = gap.start() if gap else len(signs)
        yield pa.array(signs[start:end].replace(b".", b" . ").split(), pa.binary())
        start = end
    yield STOP


def counted(ids: np.ndarray, own: int, size: int, words: int) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]]:
    """Stripes of each prefix length: (how prefixes are made up, prefix, next, count), sorted by prefix and next.

    ``ids`` numbers words from 1 to ``size`` - 1; 0 ends a piece. Phrases that begin
    in the first ``own`` places count. A next of 0 is the end of the piece. A prefix
    is a number; for prefixes of two words and more the first item gives, level by
    level, the numbers that (prefix, word) pairs got.
    """
    at = np.flatnonzero(ids[:own])
    last = np.r_[ids, np.zeros(words, ids.dtype)]
    following, n = np.unique(ids[at], return_counts=True)
    yield [], np.zeros(len(following), np.int64), following, n
    prefix, made = ids[at].astype(np.int64), []
    for length in range(1, words):
        nxt = last[at + length]
        if length > 1 or words == 2:
            pairs, n = np.unique(prefix * size + nxt, return_counts=True)
            yield made, pairs // size, pairs % size, n
        on = nxt > 0
        at = at[on]
        pairs, prefix = np.unique(prefix[on] * size + nxt[on], return_inverse=True)
        made = [*made, (pairs // size, pairs % size)]


def bundles(lang: str, found: list[pa.Array], own: int, words: int, parts: dict[str, int], buckets: int) -> Iterator[tuple[str, int, bytes]]:
    """(lang, bucket, bundle): the stripes of words, as split() gives them, bundled by a hash of prefix and part.

    ``parts``: the number of parts of hot prefixes.
    """
    coded = pa.concat_arrays([STOP, *found]).dictionary_encode()  # so that the stop is number 0
    ids, names = coded.indices.to_numpy()[1:], coded.dictionary.to_pylist()
    text = pa.concat_arrays([pa.array([b""], pa.binary()), coded.dictionary[1:]])
    crc = np.array([zlib.crc32(w) for w in names], np.uint64)
    for length, (made, prefix, following, n) in enumerate(counted(ids, own, len(names), words)):
        if not len(prefix):
            continue
        spelled, code = text, crc
        for left, right in made:
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(left)), text.take(pa.array(right)), b" ")
            code = code[left] * np.uint64(FACTOR) + crc[right]
        if length == 0:
            spelled, code = pa.array([b""], pa.binary()), np.zeros(1, np.uint64)
        part = np.zeros(len(prefix), np.int64)
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        ends = np.r_[starts[1:], len(prefix)]
        if length == 0:
            cut = [(0, len(prefix), PARTS)]
        else:
            hot = pc.index_in(spelled.take(pa.array(prefix[starts])), value_set=pa.array([k.encode() for k in parts], pa.binary())).to_numpy(zero_copy_only=False).astype(float)
            many = list(parts.values())
            cut = [(starts[i], ends[i], many[int(hot[i])]) for i in np.flatnonzero(~np.isnan(hot))]
        for a, b, p in cut:
            part[a:b] = (crc[following[a:b]] % np.uint64(p)).astype(np.int64)
            order = a + np.argsort(part[a:b], kind="stable")
            part[a:b], following[a:b], n[a:b] = part[order], following[order], n[order]
        starts = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[starts, len(prefix)])
        mixed = (code[prefix[starts]] + part[starts].astype(np.uint64) * np.uint64(FACTOR)) * np.uint64(FACTOR)
        bucket = ((mixed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts, size, bucket = starts[order], size[order], bucket[order]
        entry = np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(len(prefix))
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = np.r_[first, len(starts)]
        entries = np.r_[0, np.cumsum(size)][rows]
        joined = [pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values), b"\n") for cuts, values in ((rows, spelled.take(pa.array(prefix[starts]))), (entries, text.take(pa.array(following[entry]))))]
        n = n[entry].astype(np.int64)
        for i, at in enumerate(first):
            columns = joined[0][i].as_py(), joined[1][i].as_py(), size[rows[i] : rows[i + 1]].astype(np.int64).tobytes(), n[entries[i] : entries[i + 1]].tobytes()
            yield lang, int(bucket[at]), ZSTD.compress(struct.pack("<4q", *map(len, columns)) + b"".join(columns))


def opened(bundle: bytes) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Prefixes, next words, entries of each prefix, counts."""
    data, at, columns = UNZSTD.decompress(bundle), 32, []
    for size in struct.unpack("<4q", data[:32]):
        columns.append(data[at : at + size])
        at += size
    names = [pa.array(c.split(b"\n"), pa.binary()) for c in columns[:2]]
    return *names, np.frombuffer(columns[2], np.int64), np.frombuffer(columns[3], np.int64)


def added(bundled: list[bytes], least: int, kept: dict[str, int]) -> tuple[pa.Array, ...]:
    """Stripes of one bucket added element by element: prefix, total, size (its different next words), and the next words
    and counts of at least ``least``. Only the empty prefix, those that are ``kept`` and those of ``least`` in all stay."""
    prefixes, following, sizes, counts = (list(x) for x in zip(*map(opened, bundled), strict=True))
    left, right = pa.concat_arrays(prefixes).dictionary_encode(), pa.concat_arrays(following).dictionary_encode()
    width, codes = len(right.dictionary), np.repeat(left.indices.to_numpy().astype(np.int64), np.concatenate(sizes))
    pairs, where = np.unique(codes * width + right.indices.to_numpy(), return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, where, np.concatenate(counts))
    prefix, nxt = pairs // width, pairs % width
    starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
    size, total = np.diff(np.r_[starts, len(prefix)]), np.add.reduceat(n, starts)
    names = left.dictionary.take(pa.array(prefix[starts]))
    end = right.dictionary.index(b"").as_py()  # the end of a piece is no word
    stays = (total >= least) | pc.is_in(names, value_set=pa.array([b"", *(k.encode() for k in kept)], pa.binary())).to_numpy(zero_copy_only=False)
    large = (n >= least) & (nxt != end) & np.repeat(stays, size)
    per = np.add.reduceat(large.astype(np.int64), starts)[stays]
    offsets = pa.array(np.r_[0, np.cumsum(per)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (right.dictionary.take(pa.array(nxt[large])).cast(pa.string()), pa.array(n[large]))]
    return names.filter(pa.array(stays)).cast(pa.string()), pa.array(total[stays]), pa.array(size[stays]), *lists


def merged(texts: DataFrame, words: int, parts: dict[str, dict[str, int]], buckets: int, least: int) -> DataFrame:
    """Rows of STRIPES, a row for each prefix, for each part of one that is cut; from (lang, text) rows.

    Tasks combine up to POSITIONS words and hand on a compressed bundle for each
    bucket that these reach; one shuffle of bundles by bucket; a task adds up bucket after bucket.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[str, list[pa.Array]] = {}
        size = 0

        def hand_on(last: bool) -> Iterator[pa.RecordBatch]:
            for lang, found in sorted(held.items()):
                n = sum(map(len, found))
                own = n if last else max(0, n - words + 1)
                rows = bundles(lang, found, own, words, parts.get(lang, {}), buckets)
                while some := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["lang", "bucket", "bundle"])
                held[lang] = [pa.concat_arrays(found)[own:].take(pa.array(range(n - own), pa.int64()))]  # a text may go on

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found in split(text):
                    held.setdefault(lang, []).append(found)
                    size += len(found)
                    if size >= POSITIONS:
                        yield from hand_on(False)
                        size = 0
        yield from hand_on(True)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows = ((k, b) for batch in batches for *k, b in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (lang, _), group in groupby(rows, key=lambda r: r[0]):
            columns = added([b for _, b in group], least, parts.get(lang, {}))
            for i in range(0, len(columns[0]), ROWS):
                some = [c[i : i + ROWS] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some[0]), pa.string()), *some], names=["lang", "prefix", "total", "size", "next", "n"])

    dealt = texts.mapInArrow(build, "lang string, bucket int, bundle binary").repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    return dealt.mapInArrow(add_up, STRIPES)


def plan(texts: DataFrame, words: int) -> tuple[dict[str, dict[str, int]], int]:
    """Parts of the prefixes that hold more than 1/HOT of the stripe entries of a sample of documents (fewer than HOT of
    them), and the number of buckets. The result doesn't depend on either."""
    rows = texts.count()
    if not rows:
        return {}, 1
    share = min(1.0, SAMPLE_ROWS / rows)
    sizes = merged(texts.sample(share, seed=1), words, {}, SAMPLE_BUCKETS, 1).groupBy("lang", "prefix").agg(F.sum("size").alias("size")).checkpoint()
    total = sizes.agg(F.sum("size")).first()[0] or 0
    found: dict[str, dict[str, int]] = {}
    for r in sizes.filter((F.col("prefix") != "") & (F.col("size") * HOT > F.lit(total))).collect():
        found.setdefault(r["lang"], {})[r["prefix"]] = -(-2 * r["size"] * HOT // total)
    return found, max(SAMPLE_BUCKETS, int(total / share) // BUCKET)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = 3, least: int = 10) -> DataFrame:
    """Rows (lang, phrase, words, f): every phrase of 1 to ``words`` words that occurs at least ``least`` times, and how often
    all words occur in the row of the empty phrase (0 words)."""
    prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"), F.col(quoted(text)).alias("text")).filter("text IS NOT NULL")
    parts, buckets = plan(texts, words)
    held = staged(merged(texts, words, parts, buckets, least), "stripes")
    size = F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", " ")))
    totals = held.groupBy("lang", "prefix").agg(F.sum("total").alias("f")).filter((F.col("prefix") == "") | (F.col("f") >= least))
    totals = totals.select("lang", F.col("prefix").alias("phrase"), size.alias("words"), "f").filter("words <> 1")
    longer = held.withColumn("words", size + 1).filter(F.col("words").isin(1, words)).select("lang", "prefix", "words", F.explode(F.arrays_zip("next", "n")).alias("e"))
    longer = longer.select("lang", F.when(F.col("words") == 1, F.col("e.next")).otherwise(F.concat_ws(" ", "prefix", "e.next")).alias("phrase"), "words", F.col("e.n").alias("f"))
    return staged(totals.unionAll(longer), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of 2 to ``words`` words of each language.

    Texts are split into pieces at ``. , ; : ! ?`` and line ends, pieces into words
    at blanks and tabs; A-Z count as a-z. A candidate occurs at least ``least``
    times (a). Its score is the lowest floor(1000000 a a / (l r)) over its cuts
    into two phrases that occur l and r times, at equal scores that of the first
    cut. A candidate goes if a longer one that holds it occurs at least ``share``
    percent as often. n: all words of the language. Order: score and a descending,
    phrase ascending in UTF-8 bytes. Scores are whole numbers of 38 decimal digits
    (a below 10^15), hence exact.

    A null language is ``und`` (as is the language of that name), a null text is
    empty, repeated rows count each time, other columns don't matter, an empty
    table gives no rows. Texts of any length are handled in slices.
    """
    counts = phrase_counts(docs, text, lang, words, least)
    f = counts.filter("words > 0").select("lang", "phrase", "words", "f")
    found = f.filter("words > 1").withColumnRenamed("f", "a")
    cuts = found.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left = f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = "CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0)) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(exact))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.first("a").alias("a"))
    # a phrase inside any longer candidate is the beginning or end of one with a word more, which occurs as often at least
    ends = F.expr("array(substring_index(phrase, ' ', words - 1), substring(phrase, instr(phrase, ' ') + 1))")
    longest = found.filter("words > 2").select("lang", F.explode(ends).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    kept = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = kept.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(counts.filter("words = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
