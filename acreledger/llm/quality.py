"""Quality classification with supervised subword embeddings.

Words, pairs of neighbouring words and the character n-grams inside words are
hashed to rows of a table of vectors, learned together with a softmax output by
stochastic gradient descent. A text is the mean of its words' vectors, of its
word pairs' and of its n-grams'. Everything works on the bytes of a text with
whole-array operations: there is no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from acreledger.llm.common import crc_rest, fields, labelled_texts, map_column

BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 17, 8, 8, 0.3
ORDERS = (2, 3, 4)
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 12 * 1024 * 1024
THRESHOLD = 0.3
#: Bytes of a text that are hashed at a time; what a piece leaves open goes on in the next.
PIECE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Rows of the table for hashes of one kind."""
    h = (h + np.uint64(kind)) * MIX
    return ((h ^ (h >> np.uint64(29))) * MIX >> np.uint64(47)).astype(np.int64) & (BUCKETS - 1)


def features(data: bytes) -> list[np.ndarray]:
    """Table rows of the words, the word pairs and the n-grams of each order."""
    return [np.concatenate(k) for k in zip(*features_by_piece(data), strict=True)]


def features_by_piece(data: bytes) -> Iterator[list[np.ndarray]]:
    """The features that end in each piece; words, pairs and n-grams go on over its edges."""
    data = b" " + data + b" "
    last = np.zeros(0, dtype=np.uint64)  # the word before
    open_sum, open_size = np.uint64(0), 0  # the word that the piece before left open
    near = np.zeros(0, dtype=np.uint64)  # the letters before
    for at in range(0, len(data), PIECE):
        b = np.frombuffer(data[at : at + PIECE], dtype=np.uint8)
        space = SPACES[b]
        letters = np.where(space, 32, b).astype(np.uint64)
        # a word's hash is the sum of its bytes, each mixed with its place in the word
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
        sizes = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 - starts
        goes_on = bool(open_size) and not space[0]
        place = np.arange(len(b)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(b)]))
        if goes_on:
            place[: sizes[0]] += open_size
        mixed = np.where(space, np.uint64(0), (letters + np.uint64(1) + place.astype(np.uint64) * np.uint64(257)) * MIX)
        mixed ^= mixed >> np.uint64(31)
        mixed = np.where(space, np.uint64(0), mixed * MIX)
        sums = np.add.reduceat(mixed, starts) if len(starts) else np.zeros(0, dtype=np.uint64)
        if goes_on:
            sums[:1] += open_sum
            sizes[0] += open_size
        elif open_size:
            sums, sizes = np.r_[open_sum, sums], np.r_[open_size, sizes]
        open_sum, open_size = np.uint64(0), 0
        if not space[-1]:
            open_sum, open_size = sums[-1], int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        words = sums + sizes.astype(np.uint64)
        row = np.r_[last, words]
        same = row[1:] == row[:-1]
        pairs = np.where(same, np.uint64(7), row[:-1] * np.uint64(31) + row[1:])  # a word repeated at once is one feature
        last = row[-1:]
        found = [bucket(words, 1), bucket(pairs, 2)]
        around = np.r_[near, letters]
        for n in ORDERS:
            found.append(bucket(grams(around[max(0, len(near) - n + 1) :], n), 2 + n))
        near = around[-(max(ORDERS) - 1) :]
        yield found


def grams(letters: np.ndarray, n: int) -> np.ndarray:
    """Every n letters in a row as one number, without spaces but at the ends, and not spaces alone."""
    if len(letters) < n:
        return letters[:0]
    inside = letters == 32
    end = len(letters) - n + 1
    gram = letters[:end]
    middle = np.zeros(end, dtype=np.int8)
    for k in range(1, n):
        gram = gram << np.uint64(8) | letters[k : k + end]
        if k < n - 1:
            middle += inside[k : k + end]
    return gram[middle == 0 if n > 2 else ~(inside[:-1] & inside[1:])]


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text and their shares in its mean vector."""
    kinds = [k for k in features((text or "").encode("utf-8", "replace")) if len(k)]
    if not kinds:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    rows, back = np.unique(np.concatenate(kinds), return_inverse=True)
    weight = np.concatenate([np.full(len(k), 1 / len(k) / len(kinds)) for k in kinds])
    return rows.astype(np.int32), np.bincount(back, weights=weight).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """The learned vectors and softmax output, folded into one number for each table row: the log odds it adds."""

    vectors: np.ndarray
    output: np.ndarray
    constant: float

    @property
    def odds(self) -> np.ndarray:
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)


def learn(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model | None:
    """Stochastic gradient descent on the softmax loss, one text a step, the rate falling to nothing."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    docs = [shares(t) for t in texts]
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output = rng.uniform(-0.5, 0.5, (2, DIMENSIONS)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, step = epochs * len(docs), 0
    boost = np.float32(20)  # a mean of many hashed vectors is short
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            rows, share = docs[i]
            pace = np.float32(rate * (1 - step / steps))
            step += 1
            own = vectors[rows]
            mean = (share @ own) * boost if len(rows) else np.zeros(DIMENSIONS, dtype=np.float32)
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            error = p - np.eye(2, dtype=np.float32)[labels[i]]
            back = output.T @ error
            output -= pace * np.outer(error, mean)
            bias -= pace * error
            if len(rows):
                vectors[rows] = own - (pace * boost * share[:, None]) * back[None, :] / max(1e-3, float((share * share).sum()) * float(boost) ** 2)
    return Model(vectors * boost, output, float(bias[1] - bias[0]))


def score_text(odds: np.ndarray, constant: float, text: str | None) -> float:
    sums, counts = np.zeros(2 + len(ORDERS)), np.zeros(2 + len(ORDERS))
    for found in features_by_piece((text or "").encode("utf-8", "replace")):
        for k, rows in enumerate(found):
            sums[k] += odds[rows].sum(dtype=np.float64)
            counts[k] += len(rows)
    has = counts > 0
    z = constant + (float((sums[has] / counts[has]).mean()) if has.any() else 0.0)
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def held_out_fold(key: str = "doc_id") -> Column:
    return crc_rest(key, 5) == 0


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learn from a bounded sample of the labelled rows that ``learn_from`` allows; see ``labelled_texts``."""
    sample = labelled_texts(docs, labels, label, learn_from, sample_rows, sample_bytes)
    return learn([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append score (probability of label 1) and predicted of each whole text.

    Null and empty texts have no features and get the score of the constant
    alone. Without labels of both kinds to learn from every score is 0.5. Input
    columns named like a result are replaced.
    """
    odds, constant = (model.odds, model.constant) if model else (np.zeros(BUCKETS, dtype=np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast((odds, constant))

    def job():
        own, base = shared.value

        def of(values: list) -> list[tuple]:
            scores = [score_text(own, base, v) for v in values]
            return [(s, int(s >= threshold)) for s in scores]

        return of

    return map_column(docs, text, fields("score double, predicted int"), job)
