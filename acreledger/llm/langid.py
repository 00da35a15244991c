"""Language identification with string kernels.

A text is the set of n-grams of 1 to 3 characters (its blended spectrum) of its
lower-cased letters, anything else being one boundary sign. The kernel of two
texts is the number of n-grams they share over the geometric mean of their
numbers of n-grams. Landmark texts give a Nyström map of that kernel, in which
one ridge regression for each language against the rest is solved. Since the
kernel is a sum over n-grams, the regression folds into one weight for each
n-gram and language, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreledger.llm.common import crc_rest, distinct_sample, fields, free_name, map_column, quoted

UNKNOWN = "und"
#: Bits of a letter's number in an n-gram, and the mark of an n-gram's length above three of them.
BITS, LENGTH = 20, 60
#: Landmarks after a language's first are taken while all n-grams together are no more.
GRAMS = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)
SAMPLE_ROWS, LANDMARKS, RIDGE = 3000, 160, 0.3
CHUNK = 32
POINTS = 0x110000
ALPHA: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not ALPHA:
        ALPHA.append(np.array([chr(c).isalpha() for c in range(POINTS)], dtype=bool))
    return ALPHA[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def spectrum(text: str, signs: np.ndarray) -> np.ndarray:
    """N-grams of a text as numbers, each as often as it occurs: one, two and three signs of 20 bits below their number."""
    c = signs[code_points(text)].astype(np.int64)
    if not c.any():
        return np.zeros(0, dtype=np.int64)
    c = np.r_[0, c, 0]
    c = c[(c > 0) | np.r_[True, c[:-1] > 0]]
    two = (c[:-1] << BITS) | c[1:]
    three = (two[:-1] << BITS) | c[2:]
    return np.concatenate([c[c > 0] | 1 << LENGTH, two | 2 << LENGTH, three | 3 << LENGTH])


class Places:
    """Columns of sorted n-grams: a table by hash, and a binary search for n-grams whose hash several share."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        bits = max(10, (8 * len(grams)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, dtype=np.int32)
        slots = self.slots(grams)
        self.table[slots] = np.arange(len(grams))
        found, times = np.unique(slots, return_counts=True)
        self.table[found[times > 1]] = -2

    def slots(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def __getitem__(self, grams: np.ndarray) -> np.ndarray:
        """The column of each n-gram; for those of no landmark the one after the last."""
        none = len(self.grams)
        if not none:
            return np.zeros(len(grams), dtype=np.int32)
        out = self.table[self.slots(grams)]
        several = np.flatnonzero(out == -2)
        out[several] = np.searchsorted(self.grams, grams[several])
        out[(out < 0) | (out >= none)] = none
        known = np.flatnonzero(out < none)
        out[known[self.grams[out[known]] != grams[known]]] = none
        return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    signs: np.ndarray      # code point -> 0 boundary, 1.. the landmarks' letters, one more for other letters
    place: Places          # n-gram -> column, the last column for those of no landmark
    weights: np.ndarray    # columns x languages

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.weights) + 1), dtype=np.float32)
        for i, t in enumerate(texts):
            out[i, self.place[spectrum(t, self.signs)]] = 1
        return out[:, :-1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score from 0 to 1) of each text; ``und`` and 0 where there are no letters or nothing was learned."""
        out: list[tuple[str, float]] = []
        letter = is_letter()
        for start in range(0, len(texts), CHUNK):
            part = texts[start : start + CHUNK]
            has = [bool(t) and bool(self.languages) and bool(letter[code_points(t)].any()) for t in part]
            x = self.presence([t if ok else "" for t, ok in zip(part, has, strict=True)])
            size = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float64), 1))
            f = np.clip((x @ self.weights).astype(np.float64) / size[:, None], 0, 1) if self.languages else np.zeros((len(part), 1))
            best, total = f.argmax(axis=1), f.sum(axis=1)
            for i, ok in enumerate(has):
                out.append((self.languages[best[i]], float(f[i, best[i]] / total[i]) if total[i] > 0 else 0.0) if ok else (UNKNOWN, 0.0))
        return out


def alphabet(texts: list[str]) -> np.ndarray:
    """Every letter of the texts gets a sign of its own; letters of none of them share one."""
    seen = np.zeros(POINTS, dtype=bool)
    for t in texts:
        seen[code_points(t)] = True
    letter = is_letter()
    own = np.flatnonzero(seen & letter)
    signs = np.where(letter, len(own) + 1, 0).astype(np.int32)
    signs[own] = np.arange(1, len(own) + 1)
    return signs


def landmark_columns(texts: list[str], signs: np.ndarray) -> tuple[Places, np.ndarray]:
    """Columns of the landmarks' n-grams, and the landmarks' presence matrix."""
    sets = [np.unique(spectrum(t, signs)) for t in texts]
    place = Places(np.unique(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.int64))
    z = np.zeros((len(texts), len(place.grams)), dtype=np.float32)
    for i, s in enumerate(sets):
        z[i, place[s]] = 1
    return place, z


def fitting(texts: list[tuple[str, str]], signs: np.ndarray, most: int = GRAMS) -> list[str]:
    """Of (language, text) the first text of each language and, in the given order, those with which all n-grams are at most ``most``."""
    grams, kept, met = np.zeros(0, dtype=np.int64), [], set()
    for lang, text in texts:
        union = np.union1d(grams, spectrum(text, signs))
        if lang not in met or len(union) <= most:
            grams = union
            kept.append(text)
        met.add(lang)
    return kept


def solve(z: np.ndarray, kernel: np.ndarray, y: np.ndarray, languages: int, ridge: float) -> np.ndarray:
    """Weights of n-grams from the kernel of sample texts with the landmarks ``z``."""
    size = np.sqrt(np.maximum(z.sum(axis=1, dtype=np.float64), 1))
    own = (z @ z.T).astype(np.float64) / size[:, None] / size[None, :]
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ root
    target = (y[:, None] == np.arange(languages)).astype(np.float64)
    weight = np.sqrt(1 / np.maximum(np.bincount(y, minlength=languages), 1))[y] * np.sqrt(len(y) / languages)
    left, right = phi * weight[:, None], target * weight[:, None]
    beta = np.linalg.solve(left.T @ left + ridge * np.eye(left.shape[1]), left.T @ right)
    return (z.T.astype(np.float64) @ ((root @ beta) / size[:, None])).astype(np.float32)


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Fit on at most ``sample_rows`` distinct (text, language) pairs, of which up to ``landmarks`` whole texts come to the driver.

    ``learn`` says by the key which rows may be learned from. Every language has
    its share of the sample; landmarks are dealt to the languages in turn. The
    kernels of the other sample texts are computed where the texts are; the driver
    gets one vector of numbers for each.
    """
    known = docs.select(F.col(quoted(key)).alias(key), F.col(quoted(text)).alias("text"), F.col(quoted(lang)).cast("string").alias("lang"))
    known = known.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    pairs = distinct_sample(known, ["text", "lang"], "lang", sample_rows)
    by_lang: dict[str, list[int]] = {}
    for name, h in pairs:
        by_lang.setdefault(name, []).append(h)
    languages = tuple(sorted(by_lang))
    turns = sorted((n, name, h) for name, hs in by_lang.items() for n, h in enumerate(hs))[:landmarks]
    empty = np.zeros(POINTS, dtype=np.int32)
    if not languages:
        return Model((), empty, Places(np.zeros(0, dtype=np.int64)), np.zeros((0, 0), dtype=np.float32))
    spark = docs.sparkSession
    hashed = known.withColumn("h", F.xxhash64("text", "lang"))
    sample = hashed.join(F.broadcast(spark.createDataFrame(pairs, "lang string, h long")), ["lang", "h"])
    chosen = spark.createDataFrame([(h,) for *_, h in turns], "h long")
    marks = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()
    of_hash = {r.h: r.text for r in marks}
    texts = [(name, of_hash[h]) for _, name, h in turns]
    signs = alphabet([t for _, t in texts])
    texts = fitting(texts, signs)
    place, z = landmark_columns(texts, signs)
    unit = z.T / np.sqrt(np.maximum(z.sum(axis=1), 1))
    shared = spark.sparkContext.broadcast(Model(languages, signs, place, unit.astype(np.float32)))

    def job():
        model = shared.value

        def of(values: list) -> list[tuple]:
            found, once = {}, list(dict.fromkeys(values))
            for start in range(0, len(once), CHUNK):
                x = model.presence(once[start : start + CHUNK])
                k = (x @ model.weights).astype(np.float64) / np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float64), 1))[:, None]
                found |= zip(once[start : start + CHUNK], k.tolist(), strict=True)
            return [(found[v],) for v in values]

        return of

    rows = map_column(sample, "text", fields("k array<double>"), job).groupBy("h", "lang").agg(F.first("k").alias("k")).collect()
    rows.sort(key=lambda r: (r.h, r.lang))
    weights = solve(z, np.array([r.k for r in rows]), np.array([languages.index(r.lang) for r in rows]), len(languages), RIDGE)
    return Model(languages, signs, place, weights)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append lang_pred and score.

    A null text or one without letters has ``und`` and 0, as has every text if
    nothing could be learned. Texts are read whole. Input columns named like a
    result are replaced. Equal scores go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_column(docs, text, fields("lang_pred string, score double"), lambda: shared.value.predict)


def held_out_fold(key: str = "doc_id") -> Column:
    return crc_rest(key, 5) == 0


def accept(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose language is recognised with at least that score, all columns kept."""
    row = free_name(docs, "row_")
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(row), F.col(quoted(text)).alias("text"))
    return predict(whole, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(f"{row}.*")
