"""Encoding to and decoding from the pieces of a given SentencePiece vocabulary."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import byte_column, releasing

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units whose pieces a task remembers.
REMEMBERED = 100_000
#: What a character without a piece costs below the lowest score.
UNKNOWN_COST = 10.0


@dataclass
class Vocabulary:
    """Pieces with a space for the space mark, their ids and scores, and the ids of the 256 bytes."""

    pieces: list[tuple[str, int, float]]
    bytes: list[int]
    unknown: int
    size: int


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file; only the driver reads the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    size = model.get_piece_size()
    pieces = [
        (model.id_to_piece(i).replace("▁", " "), i, model.get_score(i)) for i in range(size) if not special(i)
    ]
    values = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(map(model.is_byte, values)):
        raise ValueError("the vocabulary needs a piece for every byte")
    return Vocabulary(pieces, values, model.unk_id(), size)


class Coder:
    """Best-scoring segmentation, and its inverse.

    A text is read with one space put before it.  No piece has a space after
    another character, nor a line feed, so the best pieces of a text are those of its units:
    some spaces with what follows them, or a line feed.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, i, score in vocabulary.pieces:
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _, _ in vocabulary.pieces if len(p) == 1}
        self.low = min(s for _, _, s in vocabulary.pieces) - UNKNOWN_COST
        self.bytes = vocabulary.bytes
        if any("\n" in p or " " in p.lstrip(" ") for p, _, _ in vocabulary.pieces):
            self.units = re.compile(r".+", re.DOTALL)
        else:
            self.units = re.compile(r" +[^ \n]*|[^ \n]+|\n")
        self.table: list[bytes] = [b""] * vocabulary.size
        for piece, i, _ in vocabulary.pieces:
            self.table[i] = piece.encode()
        for value, i in enumerate(vocabulary.bytes):
            self.table[i] = bytes([value])
        self.known: dict[str, tuple[int, ...]] = {}

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of one unit.

        The automaton reads it once.  At each place it gives, longest first, all
        pieces that end there: its state's and those along the output links.  Each
        may better the score of the place.  A character that is no piece is its
        bytes.  Of equal scores the longest last piece stays.
        """
        n = len(text)
        best = [0.0] + [-np.inf] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        done = 0  # places up to here have their final score
        for last, (i, size, score) in self.automaton.iter(text):
            end = last + 1
            while done < end - 1:
                done += 1
                self._fall_back(text, done, best, back)
            reached = best[end - size] + score
            if reached > best[end]:
                best[end], back[end] = reached, (end - size, i)
        while done < n:
            done += 1
            self._fall_back(text, done, best, back)
        ids: list[int] = []
        while n:
            start, i = back[n]
            ids += [i] if i >= 0 else [self.bytes[b] for b in reversed(text[start:n].encode())]
            n = start
        return tuple(reversed(ids))

    def _fall_back(self, text: str, end: int, best: list[float], back: list[tuple[int, int]]) -> None:
        if text[end - 1] not in self.single and best[end - 1] + self.low > best[end]:
            best[end], back[end] = best[end - 1] + self.low, (end - 1, -1)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; an empty text has none."""
        ids: list[int] = []
        known = self.known
        for unit in self.units.findall(" " + text) if text else ():
            found = known.get(unit)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = self.unit(unit)
                if len(unit) <= 64:
                    known[unit] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of some ids, without the space put before it."""
        table = self.table
        return b"".join([table[i] for i in ids])[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = MODEL, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but its own of these names, with ``ids``, ``n_tokens``, ``ids_sha256`` and ``exact``.

    ``ids_sha256`` is over the ids as four little-endian bytes each; ``exact`` tells
    whether decoding gives the text again.  A null text has null ids, no tokens, the
    digest of nothing, and is exact; an empty one has none.  Rows stay as they are.
    """
    vocabulary = load(path)
    new = ["ids", "n_tokens", "ids_sha256", "exact"]
    keep = [c for c in docs.columns if c not in new]
    # Plain names on the way through Python; the callers' own may hold dots or clash.
    plain, hidden = [f"c{i}" for i in range(len(keep))], "text"
    rows = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(keep, plain, strict=True)], F.col(text).alias(hidden))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != hidden)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)
        for batch in batches:
            # A part of a batch at a time: ids take more room than the text they come from.
            for k in range(0, len(batch), 1000):
                yield coded(coder, batch.slice(k, 1000))

    def coded(coder: Coder, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(hidden)
        data, ends = byte_column(texts)
        ids, digests, exact = [], [], []
        for s, e in zip(ends[:-1], ends[1:], strict=True):
            whole = data[s:e].tobytes().decode("utf-8", "replace")
            found = coder.encode(whole)
            ids.append(np.array(found, np.int32))
            digests.append(hashlib.sha256(ids[-1].astype("<i4").tobytes()).hexdigest())
            exact.append(coder.decode(found) == whole)
        sizes = np.array([len(i) for i in ids], np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, flat), pa.array(sizes), pa.array(digests, pa.string()), pa.array(exact, pa.bool_())],
            names=[*plain, *new],
        )

    coded_rows = rows.mapInArrow(releasing(each), schema + "ids array<int>, n_tokens bigint, ids_sha256 string, exact boolean")
    return coded_rows.toDF(*keep, *new)


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``rows`` with ``text`` from ``ids``; null ids give null."""
    vocabulary = load(path)
    keep = [c for c in rows.columns if c != "text"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(keep).schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)
        for batch in batches:
            texts = [None if i is None else coder.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.select(keep).mapInArrow(releasing(each), schema + "text string")
