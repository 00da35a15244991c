"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as signs: insults (words and word beginnings learned from
labelled texts), threat words, target words, negations and reported speech. Four
small transducers, one of each kind, are composed into one. It walks over the
signs of a clause and gives weighted matches: an insult counts more near its
target, less behind a negation or within reported speech; a threat word counts
only together with a target. The target may stand before or after them: the
target transducer walks over the clause backwards first. A logistic regression turns the scores of a text's
matched clauses into one score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreledger.llm.common import crc_rest, fields, free_name, labelled_texts, logistic, map_column, newton_logistic, quoted

# Signs of the grammar in four languages.
TARGETS = "you your yours he him his she her they them their du dich dir euch ihr sie tu toi vous ton ta votre ustedes usted tú ti él ella ellos".split()
THREATS = "kill hurt beat destroy burn stab shoot crush töten umbringen schlagen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split()
NEGATIONS = "not never no nor cannot isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun no nunca jamás ningún".split()
REPORTS = "said says say told wrote claimed quoted called reported sagte schrieb behauptete nannte dit écrit affirme déclare dijo escribió llamó declaró".split()
REACH = 4

SAMPLE_ROWS, SAMPLE_BYTES = 6000, 12 * 1024 * 1024
THRESHOLD = 0.7
TABLE_ENTRIES = 200_000
TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n|]")
ENDS = frozenset(".!?;:\n|")

State = tuple
Machine = tuple[State, Callable[[State, str], tuple[State, str, float]]]


def countdown(opener: str, mark: str, factor: float) -> Machine:
    """Marks an insult or threat within REACH words after an opening sign, unless it has the mark."""

    def step(state: int, sign: str) -> tuple[int, str, float]:
        if sign == opener:
            return REACH, sign, 0.0
        hit = state > 0 and sign[:1] in "IT" and sign != "" and mark not in sign
        return max(0, state - 1), sign + mark if hit else sign, factor if hit else 0.0

    return 0, step


def latch(opener: str, mark: str, factor: float) -> Machine:
    """Marks every insult or threat from an opening sign to the end of the clause."""

    def step(state: int, sign: str) -> tuple[int, str, float]:
        if sign == opener:
            return 1, sign, 0.0
        hit = state > 0 and sign[:1] in "IT" and sign != ""
        return state, sign + mark if hit else sign, factor if hit else 0.0

    return 0, step


def only_directed() -> Machine:
    """Lets a threat through only where a target stands near."""

    def step(state: int, sign: str) -> tuple[int, str, float]:
        if sign.startswith("T"):
            return state, ("threat" + sign[1:] if "g" in sign else ""), 0.0
        return state, ("insult" + sign[1:] if sign.startswith("I") else ""), 0.0

    return 0, step


def compose(first: Machine, then: Machine) -> Machine:
    """The transducer that feeds the outputs of the first to the second; weights add up."""
    (s1, step1), (s2, step2) = first, then

    def step(state: tuple, sign: str) -> tuple[tuple, str, float]:
        a, mid, w1 = step1(state[0], sign)
        b, out, w2 = step2(state[1], mid)
        return (a, b), out, w1 + w2

    return (s1, s2), step


def tabled(machine: Machine) -> Machine:
    """The same transducer with its arcs kept as they are first taken; its states are few."""
    start, step = machine
    arcs: dict[tuple, tuple] = {}

    def quick(state: State, sign: str) -> tuple[State, str, float]:
        key = (state, sign)
        found = arcs.get(key)
        if found is None:
            found = arcs[key] = step(state, sign)
        return found

    return start, quick


def targets() -> Machine:
    """The target transducer; read from a clause's end to its start it marks what stands before a target."""
    return countdown("G", "g", math.log(1.2))


def grammar() -> Machine:
    """Target, negation and reported-speech transducers composed with the one that reads insults and threats off."""
    return tabled(compose(compose(compose(targets(), countdown("N", "n", math.log(0.7))), latch("R", "r", math.log(0.85))), only_directed()))


def fixed_signs() -> dict[str, str]:
    signs = {}
    for words, sign in ((REPORTS, "R"), (TARGETS, "G"), (THREATS, "T"), (NEGATIONS, "N")):
        signs |= dict.fromkeys(words, sign)
    return signs


@dataclass(frozen=True)
class Lexicon:
    """Insults with their weights: whole words first, else the longest known beginning."""

    words: dict[str, float]
    beginnings: dict[str, float]
    lengths: tuple[int, ...]

    def weight(self, word: str) -> float:
        known = self.words.get(word)
        if known is not None:
            return known
        for n in self.lengths:
            if n < len(word) and (found := self.beginnings.get(word[:n])) is not None:
                return found
        return 0.0


def tokens(text: str | None) -> list[str]:
    return TOKENS.findall(text.lower()) if text else []


class Scorer:
    """Scores texts; made once in each task."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights
        self.fixed = fixed_signs()
        self.signs: dict[str, tuple[str, float]] = {}
        self.start, self.step = grammar()
        self.back_start, self.back = tabled(targets())

    def sign(self, word: str) -> tuple[str, float]:
        weight = self.lexicon.weight(word)
        found = ("I", weight) if weight > 0 else (self.fixed.get(word, ""), 0.0)
        if len(self.signs) >= TABLE_ENTRIES:
            self.signs.clear()
        if len(word) <= 64:
            self.signs[word] = found
        return found

    def clauses(self, text: str | None) -> tuple[list[tuple[float, list[tuple[str, str, float]]]], int]:
        """(score, matches (word, kind with marks, weight)) of each clause with a match, and the number of words."""
        get, sign = self.signs.get, self.sign
        found = tokens(text)
        signs = [get(t) or sign(t) for t in found]
        # only clauses with an insult or a threat are walked
        hot = [i for i, s in enumerate(signs) if s[0] in ("I", "T")]
        out, done = [], -1
        for i in hot:
            if i <= done:
                continue
            first = i
            while first > 0 and found[first - 1] not in ENDS:
                first -= 1
            last = i
            while last + 1 < len(found) and found[last + 1] not in ENDS:
                last += 1
            state, marked = self.back_start, []
            for at in range(last, first - 1, -1):
                state, name, factor = self.back(state, signs[at][0])
                marked.append((name, factor))
            state, matches = self.start, []
            for at in range(first, last + 1):
                name, before = marked.pop()
                state, kind, factor = self.step(state, name)
                if kind:
                    matches.append((found[at], kind, (signs[at][1] if name[0] == "I" else 1.0) * math.exp(before + factor)))
            done = last + 1
            if matches:
                out.append((sum(m[2] for m in matches), matches))
        return out, len(found)

    def features(self, text: str | None) -> list[float]:
        clauses, n = self.clauses(text)
        insults = {m[0] for _, ms in clauses for m in ms if m[1].startswith("insult")}
        scores = [s for s, _ in clauses] or [0.0]
        weights = sorted((self.lexicon.weight(w) for w in insults), reverse=True)
        return [math.log1p(sum(scores)), math.log1p(max(scores)), math.log1p(len(clauses)), math.log1p(len(insults)), math.log1p(sum(weights[1:])), 20 * sum(scores) / (n + 50)]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return float(logistic(np.r_[self.features(text), 1.0] @ self.weights))


def learn_lexicon(texts: list[str], labels: list[int]) -> Lexicon:
    """Words, and beginnings of words, that stand in toxic texts and hardly in others.

    A word counts by the distinct neighbours it has been seen between, so that a
    passage copied into many texts counts once. The weight is the log odds of its
    share of toxic and of other texts. Only words of toxic texts are counted.
    """
    toxic = list(dict.fromkeys(t for t, y in zip(texts, labels, strict=True) if y))
    clean = list(dict.fromkeys(t for t, y in zip(texts, labels, strict=True) if not y))
    bad: Counter[str] = Counter()
    places: dict[str, set[int]] = defaultdict(set)  # one for each text at most
    for text in toxic:
        found = tokens(text)
        for w, i in {w: i for i, w in enumerate(found) if w not in ENDS}.items():
            bad[w] += 1
            places[w].add(hash((found[i - 1] if i else "", found[i + 1] if i + 1 < len(found) else "")))
    good: Counter[str] = Counter()
    for text in clean:
        good.update(bad.keys() & set(tokens(text)))

    def odds(b: float, g: float) -> float:
        return math.log((b + 0.25) / (len(toxic) + 0.5)) - math.log((g + 0.25) / (len(clean) + 0.5))

    words: dict[str, float] = {}
    for w, b in bad.items():
        own = odds(min(b, len(places[w])), good[w])
        if len(places[w]) >= 4 and own >= 2.5:
            words[w] = own
        elif good[w] >= 2 and own < 1.5:
            words[w] = 0.0  # known not to be one, whatever it begins with
    # beginnings that several words of toxic texts share
    forms: dict[str, list[str]] = defaultdict(list)
    for w in bad:
        if words.get(w, 1.0) > 0:
            for size in range(3, min(len(w), 8)):
                forms[w[:size]].append(w)
    forms = {h: ws for h, ws in forms.items() if len(ws) >= 3 and len(set().union(*(places[w] for w in ws))) >= 5}
    texts_bad, texts_good = Counter(), Counter()
    for of, counted in ((toxic, texts_bad), (clean, texts_good)):
        for text in of:
            counted.update({h for w in set(tokens(text)) for size in range(3, min(len(w), 8)) if (h := w[:size]) in forms})
    beginnings: dict[str, float] = {}
    for head, ws in forms.items():
        own = odds(min(texts_bad[head], len(set().union(*(places[w] for w in ws)))), texts_good[head])
        if texts_bad[head] >= 3 and own >= 3.5:
            beginnings[head] = 0.8 * own
    return Lexicon(words, beginnings, tuple(sorted({len(h) for h in beginnings}, reverse=True)))


def learn(texts: list[str], labels: list[int]) -> tuple[Lexicon, np.ndarray | None]:
    """The lexicon and the weights of the score. The weights are fitted on halves that the lexicon was not learned from."""
    if len(set(labels)) < 2:
        return Lexicon({}, {}, ()), None
    order = sorted(range(len(texts)), key=lambda i: (hash_of(texts[i]), i))
    half = {i for n, i in enumerate(order) if n % 2}
    rows, y = [], []
    for own in (half, set(order) - half):
        rest = [i for i in order if i not in own]
        scorer = Scorer(learn_lexicon([texts[i] for i in rest], [labels[i] for i in rest]), None)
        for i in sorted(own):
            rows.append(scorer.features(texts[i]))
            y.append(labels[i])
    return learn_lexicon(texts, labels), newton_logistic(np.array(rows), np.array(y, dtype=np.float64), ridge=0.05)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


def held_out_fold(key: str = "doc_id") -> Column:
    return crc_rest(key, 3) == 1


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[Lexicon, np.ndarray | None]:
    """Learn from a bounded sample of the labelled rows that ``learn_from`` allows; see ``labelled_texts``."""
    sample = labelled_texts(docs, labels, label, learn_from, sample_rows, sample_bytes)
    return learn([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray | None], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Append score, predicted and matches (word, kind) of each whole text.

    Null and empty texts get the score of a text without matches. Without labels
    of both kinds to learn from every score is 0. Input columns named like a
    result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def job():
        scorer = Scorer(*shared.value)

        def one(value: str | None) -> tuple:
            s = scorer.score(value)
            return s, int(s >= threshold), [{"word": w, "kind": k} for _, ms in scorer.clauses(value)[0] for w, k, _ in ms] if s >= threshold else []

        return lambda values: list(map(one, values))

    return map_column(docs, text, fields("score double, predicted int, matches array<struct<word: string, kind: string>>"), job)


def accept(docs: DataFrame, model: tuple[Lexicon, np.ndarray | None], text: str = "text") -> DataFrame:
    """The rows that are not predicted to be toxic, all columns kept."""
    row = free_name(docs, "row_")
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(row), F.col(quoted(text)).alias("text"))
    return score(whole, model).filter("predicted = 0").select(f"{row}.*")
