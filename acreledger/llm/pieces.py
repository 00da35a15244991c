"""SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding is by backtracking instead of by a merge queue. A sequence of pieces is
the model's encoding exactly if each two neighbours are what merging makes of
their joined text. So the encoder takes the longest piece that an Aho-Corasick
automaton finds at a position, checks it against the piece before it by merging
the two anew (kept in a table), falls back to the next shorter piece, and steps
back when none is left. One bit a position remembers where no way on was found.

Characters that pieces join, directly or through others, form classes; spaces
stand only at the start of pieces. So a text falls into stretches of one class
(words, punctuation, characters that the vocabulary lacks), with the spaces
before them, that are encoded apart. Stretches that recur come from a table
of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from acreledger.llm.common import KEPT, fields, map_column

SPACE = "▁"
#: Entries of a table in a worker: some 100 MB in all.
TABLE_ENTRIES = 200_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


@dataclass(frozen=True)
class PieceModel:
    """What encoding and decoding need of a model file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    end_id: int
    unknown_surface: str
    dummy_prefix: bool
    key: str

    @staticmethod
    def load(path: str) -> PieceModel:
        """Read a model file. Only BPE models with byte fallback and without normalisation are taken."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        data = open(path, "rb").read()
        model = proto.ModelProto()
        model.ParseFromString(data)
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = tuple(p.type for p in model.pieces)
        if spec.model_type != spec.BPE or not spec.byte_fallback or kinds.count(BYTE) != 256:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix or USER in kinds:
            raise ValueError("models that normalise text, strip spaces or hold user-defined pieces aren't supported")
        pieces = tuple(p.piece for p in model.pieces)
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds, strict=True) if k == NORMAL):
            raise ValueError("pieces that run over the start of a word aren't supported")
        return PieceModel(pieces, tuple(p.score for p in model.pieces), kinds, spec.eos_id, spec.unk_surface, norm.add_dummy_prefix, hashlib.sha256(data).hexdigest())


class Codec:
    """Encodes and decodes with one model; made once in each Python worker."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.score = {p: model.scores[i] for p, i in self.ids.items()}
        #: The surface of every piece but byte pieces.
        self.plain = {i: "" if k == CONTROL else model.unknown_surface if k == UNKNOWN else p.replace(SPACE, " ") for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k != BYTE}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.known = {p for p in self.ids if len(p) == 1}
        self.fits_table: dict[tuple[str, str], bool] = {}
        #: Merges in their order, four apart: a merge left of, at and right of a border is told by the steps between.
        self.place = {p: 4 * n for n, p in enumerate(sorted(self.ids, key=lambda p: -self.score[p]))}
        self.undone_table: dict[str, tuple[int, str, str]] = {}
        self.made_table: dict[str, bool] = {}
        self.shorter_table: dict[str, str] = {}
        self.stretches: dict[str, tuple[str, str]] = {}
        self.stretch_of = re.compile(self.stretch_pattern(), re.DOTALL).findall

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merge rule itself: join the best-scored neighbours, leftmost first, until none can be joined; also the last two joined."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = ["".join(last)]
        return parts, last

    def undone(self, piece: str) -> tuple[int, str, str]:
        """The place of a piece's last merge in the order of merges and what it joined; -1 for a single character."""
        found = self.undone_table.get(piece)
        if found is None:
            last = self.merges(piece)[1]
            found = self.undone_table[piece] = (self.place[piece], *last) if last else (-1, "", "")
        return found

    def made(self, piece: str) -> bool:
        """Whether merging the characters of a piece ends in that piece."""
        found = self.made_table.get(piece)
        if found is None:
            found = self.made_table[piece] = self.merges(piece)[0] == [piece]
        return found

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives these two again (with no left one: the right one).

        Merges are taken back, latest first, and at each stage the two symbols at
        the border must not have been joined before the merge that was taken back.
        """
        if not left:
            return self.made(right)
        known = self.fits_table.get((left, right))
        if known is None:
            known = self.made(right) and self.border_holds(left, right)
            if len(self.fits_table) >= TABLE_ENTRIES:
                self.fits_table.clear()
            self.fits_table[left, right] = known
        return known

    def border_holds(self, left: str, right: str) -> bool:
        place, undone = self.place, self.undone
        on_left, _, rest = undone(left)
        on_right, start, _ = undone(right)
        limit = len(place) * 4
        while True:
            joined = place.get(left + right)
            if joined is not None and joined + 1 < limit:
                return False
            if on_left > on_right:  # of equal merges the one further left came first
                limit, left = on_left, rest
                on_left, _, rest = undone(left)
            elif on_right < 0:
                return True
            else:
                limit, right = on_right + 2, start
                on_right, start, _ = undone(right)

    def shorter(self, piece: str) -> str:
        """The longest piece that is a proper prefix of this one, else empty."""
        found = self.shorter_table.get(piece)
        if found is None:
            found = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), "")
            self.shorter_table[piece] = found
        return found

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a stretch all of whose characters are pieces themselves."""
        size = len(text)
        longest = [1] * size
        for end, length in self.automaton.iter(text):
            longest[end + 1 - length] = length  # ends ascend, so the longest piece from a start comes last
        table, fits, shorter = self.fits_table, self.fits, self.shorter
        open_ = -1
        taken: list[str] = []
        last, at, piece = "", 0, text[: longest[0]]
        while True:
            end = at + len(piece)
            good = table.get((last, piece))
            if (fits(last, piece) if good is None else good) and open_ >> end & 1:
                taken.append(piece)
                if end == size:
                    return taken
                last, at, piece = piece, end, text[end : end + longest[end]]
                continue
            piece = shorter(piece)
            while not piece:
                if not taken:
                    raise ValueError(f"no encoding of {text!r}")
                open_ &= ~(1 << at)
                at -= len(last)
                piece = shorter(taken.pop())
                last = taken[-1] if taken else ""

    def stretch(self, text: str) -> tuple[str, str]:
        """Ids and decoded text of a stretch that no piece runs out of, kept in a table."""
        found = self.stretches.get(text)
        if found is None:
            body = text if text[-1] in self.known else text[:-1]  # a character that the vocabulary lacks stands last
            ids = [self.ids[p] for p in self.backtrack(body)] if body else []
            ids += [self.byte_ids[b] for b in text[len(body) :].encode("utf-8", "replace")]
            found = " " + " ".join(map(str, ids)), self.surface(ids)
            self.keep(text, found)
        return found

    def keep(self, text: str, found: tuple[str, str]) -> None:
        if len(text) <= 64:
            if len(self.stretches) >= TABLE_ENTRIES:
                self.stretches.clear()
            self.stretches[text] = found

    def surface(self, ids: list[int]) -> str:
        """Decoded text, the space before the first word still in place. Runs of byte pieces become their characters."""
        plain = self.plain
        try:
            return "".join([plain[i] for i in ids])
        except KeyError:
            pass
        out: list[str] = []
        pending = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(bytes(pending).decode("utf-8", "replace"))
                pending = bytearray()
            if i is not None:
                out.append(plain[i])
        return "".join(out)

    def split(self, text: str) -> list[str]:
        """A text as stretches that no piece runs out of, spaces marked."""
        if not text:
            return []
        return self.stretch_of((SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE))

    def stretch_pattern(self) -> str:
        """Runs of characters that pieces join, directly or through others, with the spaces before them; else single characters."""
        kin: dict[str, str] = {}

        def head(c: str) -> str:
            while kin.setdefault(c, c) != c:
                c = kin[c]
            return c

        for piece in self.ids:
            body = piece.lstrip(SPACE)
            for a, b in zip(body, body[1:], strict=False):
                kin[head(a)] = head(b)
        runs: dict[str, list[str]] = {}
        for c in kin:
            runs.setdefault(head(c), []).append(c)
        joined = sorted((sorted(r) for r in runs.values()), key=len, reverse=True)
        return "|".join([*(f"{SPACE}*[{''.join(map(re.escape, r))}]+" for r in joined), f"{SPACE}+.?", "."])

    def written(self, text: str | None) -> tuple[str, str]:
        """Ids of a whole text with the end id, as decimals joined by one space, and the text decoded from them."""
        get, stretch = self.stretches.get, self.stretch
        found = [get(p) or stretch(p) for p in self.split(text or "")]
        ids = "".join([f[0] for f in found]) + f" {self.model.end_id}"
        return ids[1:], self.unprefixed("".join([f[1] for f in found]))

    def unprefixed(self, surface: str) -> str:
        return surface[1:] if self.model.dummy_prefix and surface[:1] == " " else surface

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.written(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return self.unprefixed(self.surface(ids))


def codec(model: PieceModel) -> Codec:
    if model.key not in KEPT:
        KEPT.clear()
        KEPT[model.key] = Codec(model)
    return KEPT[model.key]


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Append ``ids`` (array of ints, an end id last) and ``decoded`` (text decoded from them).

    A null or empty text has the end id alone and decodes to an empty text.
    Texts of any length are encoded whole. Input columns named like a result are
    replaced; all others, repeated rows and row count stay. The model file is
    read on the driver (a vocabulary, fixed size) and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def job():
        coder = codec(shared.value)

        def of(texts: list) -> list[tuple]:
            return [(np.array(ids.split(), dtype=np.int32), decoded) for ids, decoded in map(coder.written, texts)]

        return of

    return map_column(docs, text, fields("ids array<int>, decoded string"), job, keeps=True)


def encode_digests(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """As ``encode``, with n_tokens, ids_sha256 and decoded_sha256 in place of ids and text.

    The digests are taken where the ids are made, so that they needn't leave the worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def job():
        coder = codec(shared.value)

        def one(text: str | None) -> tuple[int, str, str]:
            ids, decoded = coder.written(text)
            return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()

        return lambda texts: list(map(one, texts))

    return map_column(docs, text, fields("n_tokens long, ids_sha256 string, decoded_sha256 string"), job, keeps=True)
