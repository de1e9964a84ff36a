"""Packing of tokenized documents into windows of equal size, best fit decreasing.

Tokens. A document is the ids that the ``tokenizers`` library gives for its whole text,
without special tokens, and the ``end`` id. Texts are cut before single spaces that follow
something other than white space, where the tokenizer's own first cut always lies, so that
each stretch is encoded once and kept in a bounded store of the worker.

Pieces. Overlong documents are first cut into full windows; what is left is one piece. Only
their numbers are shuffled, not the ids.

Windows. Pieces are dealt evenly into shards of about ``SHARD`` pieces, by a hash that also
tells repeated rows apart. A shard's pieces come longest first; each goes to the open window
with the least room that still holds it, which a segment tree over the room left finds in a
few steps, or to a new one. Shards are packed on their own, which costs at most the last
windows of each. Nothing is dropped: every id lies in just one piece.

Defined cases. Null text is empty: its document is the end id alone. Null ids and repeated
rows are packed like any others. No rows give no pieces. ``pack`` writes the pieces to the
shared folder and counts them while the plan is built.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm.common import arrays, keeps, texts, works_for
from tallyrank.session import write_through

WINDOW = 2048
END = 1
#: Pieces of a shard.
SHARD = 50_000
#: Stretches kept in a worker, in each of two generations, and the longest one kept.
KEPT, LONGEST_KEPT = 200_000, 48
#: How byte-level vocabularies of this kind cut a text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S) ")
_ASCII_GAPS = tuple(c + " " for c in map(chr, range(128)) if c.isspace())
_OTHER_GAPS = tuple(c + " " for c in map(chr, range(128, 0x3001)) if c.isspace())


def stretches(text: str) -> list[str]:
    """The text cut at every space after something other than white space; cuts drop the space."""
    gaps = _ASCII_GAPS if text.isascii() else _ASCII_GAPS + _OTHER_GAPS
    if text.startswith(" ") or any(g in text for g in gaps):
        return _CUT.split(text)
    return text.split(" ")


def _byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _merger(file: dict):
    """The same vocabulary for a quicker merger of the same kind; None unless it is byte-level
    BPE whose ids stand in the order of its merges."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not file.get("normalizer")
    extra = [model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "unk_token")]
    if model.get("type") not in (None, "BPE") or not plain or any(extra) or before.get("use_regex") is False:
        return None
    byte_of, special = _byte_characters(), {t["content"] for t in file.get("added_tokens", [])}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    base = [model["vocab"].get(c) for c in byte_of]
    if None in base or sorted(base) != list(range(256)) or ids != list(range(256, 256 + len(ids))):
        return None
    import tiktoken

    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids as little-endian 32-bit numbers, with a store of stretches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.path = path
        self.merger = _merger(described)
        self.special = tuple(t["content"] for t in described.get("added_tokens", []))
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, read where the merger cannot do."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, parts: list[str]) -> list[bytes]:
        if self.merger and not any(s in p for s in self.special for p in parts):
            encode = self.merger.encode_ordinary
            return [np.array(encode(p), dtype="<u4").tobytes() for p in parts]
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def encode(self, batch: list[str | None]) -> list[bytes]:
        if len(self.kept) >= KEPT:
            self.older, self.kept = self.kept, {}
        kept = self.kept
        cut = [stretches(t or "") for t in batch]
        first = self._ids([c.pop(0) for c in cut])
        missing = set(chain.from_iterable(cut)).difference(kept)
        known = {w: self.older[w] for w in missing if w in self.older}
        kept.update(known)
        new = [w for w in missing if w not in known]
        kept.update(zip(new, self._ids([" " + w for w in new])))
        take = kept.__getitem__
        found = [f + b"".join(map(take, c)) for f, c in zip(first, cut)]
        for word in new:
            if len(word) > LONGEST_KEPT:
                del kept[word]
        return found


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    """The tokenizer, once in a worker."""
    return Encoder(path)


keeps("packing", load.cache_clear)


def pieces(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", *, window: int = WINDOW, end: int = END,
    keep_ids: bool = False,
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens) of each piece, with its ids if asked for."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    last = np.array([end], dtype="<u4").tobytes()
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    schema += ", ids array<int>" if keep_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        works_for("packing")
        encoder = load(tokenizer)
        for keys, column in arrays(batches, "doc_id", "text"):
            for at, part in texts(column):
                owner, start, length, crc, total, ids = [], [], [], [], [], []
                for i, found in enumerate(encoder.encode(part)):
                    found += last
                    for begin in range(0, len(found), 4 * window):
                        own = found[begin:begin + 4 * window]
                        owner.append(i)
                        start.append(begin // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        total.append(len(found) // 4)
                        if keep_ids:
                            ids.append(np.frombuffer(own, dtype="<i4"))
                columns = [keys.slice(at, len(part)).take(pa.array(owner))]
                columns += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
                columns += [pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names[:len(columns)])

    return rows.mapInArrow(cut, schema)


class Open:
    """Open windows by the room they have left, under a segment tree of their numbers."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, room: int, sequence: int) -> None:
        self.by_room[room].append(sequence)
        self._change(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least ``length``."""
        at, count = length + self.leaves, self.count
        while not count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not count[at]:
                at += 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.by_room[room].pop()


def best_fit(lengths: list[int], window: int, state: tuple[Open, int] | None = None):
    """Places lengths that come in descending order: (sequence, offset) each, and the new state."""
    opened, following = state or (Open(window), 0)
    placed = []
    for length in lengths:
        found = opened.tightest(length) if length < window else None
        if found is None:
            found = window, following
            following += 1
        room, sequence = found
        placed.append((sequence, window - room))
        if room > length:
            opened.add(room - length, sequence)
    return placed, (opened, following)


def pack(cut: DataFrame, *, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to the pieces of :func:`pieces`."""
    cut = write_through(cut, "pieces")
    shards = max(1, -(-cut.count() // shard))
    columns = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    names = [*columns, "sequence_id", "offset"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*columns).schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("_shard").to_numpy()
            border = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            lengths = batch.column("length").to_pylist()
            sequence, offset = [], []
            for s, e in zip(border[:-1].tolist(), border[1:].tolist()):
                if at != own[s]:
                    at, state = own[s], None
                placed, state = best_fit(lengths[s:e], window, state)
                sequence += [(int(at) << 32) + p[0] for p in placed]
                offset += [p[1] for p in placed]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names
            )

    key = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    dealt = cut.select(*columns).withColumn("_shard", F.pmod(key, F.lit(shards)))
    return (
        dealt.repartition("_shard").sortWithinPartitions("_shard", F.desc("length"), "doc_id", "start")
        .mapInArrow(place, f"{schema}, sequence_id long, offset long")
    )
