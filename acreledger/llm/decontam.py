"""Benchmark decontamination with training suffix arrays.

Each shard of training texts (some of the documents of a task) gets a suffix
array over its words; every suffix of the benchmark items is binary-searched in
it, which gives its longest verbatim match and, as a range of the array, all
places of its first window. Words are numbered by the benchmark's vocabulary;
other words end a match, so the array leaves out suffixes that a window can't
start with. Shards hold a bounded number of words, but a document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreledger.llm.common import ASCII_LOWER, fields, free_name, map_column, quoted, with_results

WINDOW = 13
SHARD_WORDS = 250_000
#: Benchmark text is broadcast in blocks of at most this many bytes; each block is one more pass over the texts.
BLOCK_BYTES = 8 * 1024 * 1024
RESULTS = ("n_words", "hit_spans", "n_hit", "item_ids", "longest_match", "longest_start")
#: A-Z lower-cased, all other ASCII but digits and a-z turned into a space.
WORD_BYTES = bytes(b if b > 127 else ASCII_LOWER[b] if chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split(b" ") if text else []


def words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


@dataclass
class Items:
    """A block of benchmark items: numbered words and the windows that start at each word."""

    vocabulary: dict[bytes, int]
    tokens: np.ndarray          # words of the distinct item texts, a zero after each
    starts: np.ndarray          # where a window starts
    sizes: np.ndarray           # and its number of words
    of: list[tuple[str, ...]]   # ids of the items that hold this text
    item: np.ndarray            # per window, the index into ``of``
    shortest: int = 0
    longest: int = 0

    @staticmethod
    def number(items: list[tuple[str | None, str | None]], window: int) -> Items:
        by_text: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            if item_id is not None and (key := tuple(words(text))):
                by_text.setdefault(key, set()).add(item_id)
        vocabulary: dict[bytes, int] = {}
        tokens, starts, sizes, item = [], [], [], []
        for n, key in enumerate(by_text):
            size, at = min(window, len(key)), len(tokens)
            tokens += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in key] + [0]
            starts += range(at, at + len(key) - size + 1)
            sizes += [size] * (len(key) - size + 1)
            item += [n] * (len(key) - size + 1)
        array = lambda x: np.array(x, dtype=np.int64)
        return Items(vocabulary, array(tokens), array(starts), array(sizes), [tuple(sorted(v)) for v in by_text.values()], array(item), min(sizes, default=0), max((len(k) for k in by_text), default=0))


def shared_prefix(tokens: np.ndarray, at: np.ndarray, others: np.ndarray, there: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that the suffixes of ``tokens`` at ``at`` and of ``others`` at ``there`` have in common, up to ``most``. Zeros match nothing."""
    size = np.zeros(len(at), dtype=np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        a, b = tokens[at[live] + size[live]], others[there[live] + size[live]]
        live = live[(a == b) & (a > 0)]
        size[live] += 1
        live = live[size[live] < most[live]]
    return size


class SuffixArray:
    """The suffixes of a shard's numbered words that can start a window, in order."""

    def __init__(self, numbers: np.ndarray, shortest: int, depth: int):
        zeros = np.flatnonzero(numbers == 0)
        run = zeros[np.searchsorted(zeros, np.arange(len(numbers)))] - np.arange(len(numbers))
        inside = run > 0
        ends = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])  # where runs start
        keep = np.zeros(len(numbers), dtype=bool)
        for start in ends[run[ends] >= shortest]:
            keep[start : start + run[start] + 1] = True  # with the zero behind it
        self.place = np.flatnonzero(keep)
        self.words = np.r_[numbers[self.place], 0]
        suffixes = np.flatnonzero((self.words[:-1] > 0) & (run[self.place] >= shortest))
        rank, step = self.words.copy(), 1
        while step < depth and len(suffixes):  # prefix doubling
            after = np.minimum(np.arange(len(rank)) + step, len(rank) - 1)
            joint = np.where(rank > 0, rank * (int(rank.max()) + 1) + rank[after], 0)
            _, rank = np.unique(joint, return_inverse=True)
            step *= 2
        self.order = suffixes[np.argsort(rank[suffixes], kind="stable")]

    def search(self, tokens: np.ndarray, at: np.ndarray, most: np.ndarray, right: bool) -> np.ndarray:
        """By binary search: how many suffixes stand before these prefixes of ``most`` words or, with ``right``, also start with them."""
        low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(self.order), dtype=np.int64)
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) // 2
            q, there = at[live], self.order[mid]
            same = shared_prefix(tokens, q, self.words, there, most[live])
            whole = same == most[live]
            before = np.where(whole, right, self.words[there + same] < tokens[q + np.where(whole, 0, same)])
            low[live[before]], high[live[~before]] = mid[before] + 1, mid[~before]
        return low


def matches(docs: list[list[bytes]], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, first word, words of the window, words of the longest match from there, item) for each occurrence of a window."""
    if not len(items.starts):
        return
    get = items.vocabulary.get
    numbers, first = [], []
    for words_ in docs:
        first.append(len(numbers))
        numbers += [get(w, 0) for w in words_]
        numbers.append(0)
    array = SuffixArray(np.array(numbers, dtype=np.int64), items.shortest, items.longest)
    if not len(array.order):
        return
    at, size = items.starts, items.sizes
    low = array.search(items.tokens, at, size, False)
    high = array.search(items.tokens, at, size, True)
    hit = np.flatnonzero(high > low)
    for some in np.array_split(hit, max(1, int((high - low)[hit].sum()) // 200_000)):
        count = high[some] - low[some]
        which = np.repeat(some, count)
        there = array.order[np.repeat(low[some] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())]
        longest = shared_prefix(items.tokens, at[which], array.words, there, np.full(len(which), items.longest))
        place = array.place[there]
        doc = np.searchsorted(np.array(first), place, side="right") - 1
        yield from zip(doc.tolist(), (place - np.array(first)[doc]).tolist(), size[which].tolist(), longest.tolist(), items.item[which].tolist(), strict=True)


def shards(texts: list, most: int = SHARD_WORDS) -> Iterator[tuple[list[list[bytes]], int]]:
    """Consecutive documents of at most ``most`` words together (a longer one alone), as word lists, and the index of the first."""
    part: list[list[bytes]] = []
    start = total = 0
    for i, text in enumerate(texts):
        found = words(text)
        if part and total + len(found) > most:
            yield part, start
            part, start, total = [], i, 0
        part.append(found)
        total += len(found)
    if part:
        yield part, start


def scan(texts: list, items: Items) -> list[tuple[int, list[int], list[str], int, int, int]]:
    """Per text: words, hit spans (start, end, ...), ids of items with occurring windows, longest match: words, place; nothing is cut."""
    out: list = []
    for docs, _ in shards(texts):
        spans: dict[int, list[tuple[int, int]]] = {}
        ids: dict[int, set[int]] = {}
        best: dict[int, tuple[int, int]] = {}
        for doc, start, size, longest, item in matches(docs, items):
            spans.setdefault(doc, []).append((start, start + size))
            ids.setdefault(doc, set()).add(item)
            best[doc] = max(best.get(doc, (0, 0)), (longest, -start))
        for i, found in enumerate(docs):
            length, at = best.get(i, (0, 0))
            out.append((len(found), merged(spans.get(i, [])), sorted({x for n in ids.get(i, ()) for x in items.of[n]}), length, -at))
    return out


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Disjoint spans (start, end, start, end, ...) that cover the same words."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The distinct items, read partition by partition, in blocks of at most ``most`` bytes (a larger item alone)."""
    part, total = [], 0
    for row in benchmark.select(F.col(quoted(item)).cast("string").alias("i"), F.col(quoted(text)).alias("t")).dropna().distinct().toLocalIterator():
        size = len(row.t.encode("utf-8", "replace"))
        if part and total + size > most:
            yield part
            part, total = [], 0
        part.append((row.i, row.t))
        total += size
    if part:
        yield part


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Append what of each text occurs in the benchmark.

    n_words; hit_spans (array of word places: start, end, start, end, ...; the
    words inside any occurrence of a window of ``window`` consecutive words of an
    item, or of a shorter item as a whole); n_hit (words in them); item_ids
    (items with occurring windows, as sorted distinct strings); longest_match and
    longest_start (words and place of the longest verbatim match). Null and empty
    texts have no words and no hits; items that are null, have a null id or no
    words match nothing; repeated items count once. The benchmark goes to the
    tasks in blocks of bounded size; each block is searched in every text.
    """
    spark = docs.sparkSession
    state = free_name(docs, "state_")
    docs = docs.select(*(F.col(quoted(c)) for c in with_results(docs, RESULTS)))
    found: list[str] = []
    for n, block in enumerate([*blocks(benchmark, item, item_text)] or [[]]):
        shared = spark.sparkContext.broadcast(Items.number(block, window))

        def job(shared=shared):
            return lambda texts: [({"n": n, "spans": s, "ids": i, "size": size, "at": at},) for n, s, i, size, at in scan(texts, shared.value)]

        found.append(f"{state}{n}")
        docs = map_column(docs, text, fields(f"{found[-1]} struct<n: long, spans: array<long>, ids: array<string>, size: long, at: long>"), job)
    column = lambda name: [F.col(f"{c}.{name}") for c in found]
    spans = column("spans")[0] if len(found) == 1 else F.udf(lambda *s: merged([(x[i], x[i + 1]) for x in s for i in range(0, len(x), 2)]), "array<long>")(*column("spans"))
    ends = [F.struct(size.alias("size"), (-at).alias("at")) for size, at in zip(column("size"), column("at"), strict=True)]
    best = ends[0] if len(ends) == 1 else F.greatest(*ends)
    covered = F.aggregate(F.col("hit_spans"), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")), lambda a: a["sum"])
    return (
        docs.withColumn("n_words", column("n")[0]).withColumn("hit_spans", spans)
        .withColumn("n_hit", covered)
        .withColumn("item_ids", F.array_sort(F.array_distinct(F.concat(*column("ids")))))
        .withColumn("longest_match", best["size"]).withColumn("longest_start", -best["at"])
        .drop(*found)
    )


def contaminated(share: int = 20) -> F.Column:
    """The rule for removal: some word is hit, and at least one word in ``share``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The input rows without the contaminated ones, all columns kept, also those named like a result of ``find``."""
    row = free_name(docs, "row_")
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(row), F.col(quoted(text)).alias("text"))
    return find(whole, benchmark, "text", item, item_text, window).filter(~contaminated(share)).select(f"{row}.*")
