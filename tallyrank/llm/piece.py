"""Exact SentencePiece encoding and decoding for models of the merge type.

Encoding. An Aho-Corasick automaton finds every piece in a stretch of text. From the left,
the longest piece is taken that is compatible with the one before it; two pieces are
compatible if merging their characters anew, highest score first, gives just these two.
Where no piece fits, the position is noted as failed, the piece before it is taken back and
its next shorter one is tried; no piece may end at a failed position again. The result is
the only sequence whose neighbours are all compatible, which is what merging gives. A
character without a piece becomes its UTF-8 bytes.

Stretches. No piece has a word mark after another character, so that merging never crosses
the place before a run of marks. Each such stretch is encoded once and kept in a bounded
store; a model in which some piece does cross it is encoded in one stretch.

Decoding. Pieces are put together, runs of byte pieces read as UTF-8, marks turned to spaces
and the space put before the text taken away.

Defined cases. Null text is empty; an empty text has no ids. Texts are taken whole, however
long. The model file's path is a parameter and must be readable where tasks run. Nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrank.llm.common import texts

MARK = "▁"
#: Stretches and pairs of pieces kept in a worker, in each of two generations.
KEPT = 150_000
#: Longer stretches are not kept.
LONGEST_KEPT = 48


class Recent(dict):
    """Values worked out on demand. A full store becomes the older one, and the one before
    that is dropped, so that what is asked for often stays."""

    def __init__(self, make, size: int = KEPT):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Model:
    """Pieces of a model file."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.ids, self.scores, self.bytes = [], {}, {}, {}
        self.byte_of: dict[int, int] = {}
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            self.pieces.append(piece)
            if library.is_byte(i):
                self.byte_of[i] = int(piece[3:-1], 16)
                self.bytes[self.byte_of[i]] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = library.get_score(i)
        self.silent = {i for i in range(len(self.pieces)) if library.is_control(i)}
        self.unknown = library.unk_id()
        self.pairs = Recent(self._fit_together, 2 * KEPT)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in self.pieces]
        self.shorter: list[int | None] = [None] * len(self.pieces)
        for piece, i in self.ids.items():
            begun = (piece[:n] for n in range(len(piece) - 1, 0, -1))
            self.shorter[i] = next((self.ids[p] for p in begun if p in self.automaton), None)
        self.plain = [None if i in self.byte_of or i in self.silent or i == self.unknown else p.replace(MARK, " ")
                      for i, p in enumerate(self.pieces)]
        self.stretched = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.stretches = Recent(self._stretch)

    def merged(self, text: str) -> list[str]:
        """Pieces by merging neighbours, highest score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit_together(self, pair: tuple[int, int]) -> bool:
        left, right = self.pieces[pair[0]], self.pieces[pair[1]]
        return self.merged(left + right) == [left, right]

    def _shorter(self, piece: int, char: str) -> int | None:
        """The next shorter piece that begins like ``piece``; None after the last."""
        if piece < 0:
            return None
        found = self.shorter[piece]
        return ~ord(char) if found is None and char not in self.ids else found

    def backtracked(self, text: str) -> list[int]:
        """Ids of one stretch; a character without a piece is the complement of its code point."""
        size, longest = len(text), {}
        for end, (length, piece) in self.automaton.iter(text):
            longest[end + 1 - length] = piece
        failed, pairs, lengths = bytearray(size + 1), self.pairs, self.lengths
        taken: list[int] = []
        at, piece = 0, longest.get(0)
        if piece is None and size:
            piece = ~ord(text[0])
        while at < size:
            before = taken[-1] if taken else -1
            while piece is not None:
                end = at + (lengths[piece] if piece >= 0 else 1)
                if not failed[end] and (before < 0 or piece < 0 or pairs[before, piece]):
                    break
                piece = self._shorter(piece, text[at])
            if piece is not None:
                taken.append(piece)
                at = end
                piece = longest.get(at)
                if piece is None and at < size:
                    piece = ~ord(text[at])
            else:
                failed[at] = 1
                last = taken.pop()
                at -= lengths[last] if last >= 0 else 1
                piece = self._shorter(last, text[at])
        return taken

    def _ids(self, stretch: str) -> list[int]:
        taken = self.backtracked(stretch)
        if not taken or min(taken) >= 0:
            return taken
        found: list[int] = []
        for piece in taken:
            if piece >= 0:
                found.append(piece)
            else:
                own = [self.bytes.get(b, self.unknown) for b in chr(~piece).encode("utf-8", "surrogatepass")]
                found.extend(own if self.unknown not in own else [self.unknown])
        return found

    def _stretch(self, word: str) -> tuple[str, str]:
        ids = self._ids(MARK + word)
        return ",".join(map(str, ids)), self.text_of(ids)

    def parts(self, text: str) -> list[tuple[str, str]]:
        """For each stretch its ids in decimal, and the text they decode to."""
        if not text:
            return []
        if self.stretched:
            return [self._stretch(text.replace(" ", MARK))]
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            marked = MARK + text.replace(" ", MARK)
            words = [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", marked)]
        else:
            words = text.split(" ")
        kept, make = self.stretches, self._stretch
        if len(max(words, key=len)) <= LONGEST_KEPT:
            return [kept[w] for w in words]
        return [kept[w] if len(w) <= LONGEST_KEPT else make(w) for w in words]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in self.parts(text or "") for i in ids.split(",")]

    def text_of(self, ids: list[int]) -> str:
        """Pieces put together; the space before the text is still there."""
        plain = [self.plain[i] for i in ids]
        if None not in plain:
            return "".join(plain)
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.plain[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.text_of(ids).removeprefix(" ")


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """The model, once in a worker."""
    return Model(path)


def encoded(text: Column, path: str) -> Column:
    """Ids of each text as an array of int."""

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        model = load(path)
        return pa.array([model.encode(t) for _, part in texts(column) for t in part], pa.list_(pa.int32()))

    return ids(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of each array of ids; null for a null array."""

    @F.arrow_udf("string")
    def back(column: pa.Array) -> pa.Array:
        model = load(path)
        found = [None if i is None else model.decode(i) for _, part in texts(column) for i in part]
        return pa.array(found, pa.string())

    return back(ids)


def round_trip(text: Column, path: str) -> Column:
    """Struct of the number of ids, and the digests of the ids and of the text they decode to.

    Ids are turned back stretch by stretch, so that no array of them leaves the worker.
    """

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def trip(column: pa.Array) -> pa.Array:
        model, rows = load(path), []
        for _, part in texts(column):
            for t in part:
                parts = model.parts(t or "")
                ids = ",".join([p[0] for p in parts])
                back = "".join([p[1] for p in parts]).removeprefix(" ")
                rows.append((
                    ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(),
                    hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(),
                ))
        kinds = (pa.int64(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return trip(text)
