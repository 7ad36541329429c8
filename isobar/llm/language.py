"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import byte_column, releasing, spare

DIMENSIONS = 1024
UNKNOWN = "und"
#: More learned languages than this raise: the prototypes go to every task.
MOST_LANGUAGES = 2_000

_GAP = 0
_SEED = 11
#: Letters taken together when a text is long; bounds the arrays of one step.
_PIECE = 1 << 18


#: Whether each of the first code points is a letter; later ones are asked one by one.
_LETTERS = np.array([chr(p).isalpha() for p in range(0x3000)])


def _symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; all else is a gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _LETTERS[np.minimum(points, len(_LETTERS) - 1)]
    for point in np.unique(points[points >= len(_LETTERS)]).tolist():
        letter[points == point] = chr(point).isalpha()
    return np.where(letter, points, _GAP)


def trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a UTF-8 text and how often each occurs.

    Letters are lower-cased; a run of other characters, and either end of the text,
    is one gap.  Trigrams hold at least one letter.
    """
    whole = text.decode("utf-8", "replace")
    found: dict[int, int] | None = None
    codes = counts = np.zeros(0, np.int64)
    carried = np.array([_GAP])
    for k in range(0, max(1, len(whole)), _PIECE):
        piece = np.concatenate((carried, _symbols(whole[k : k + _PIECE])))
        if k + _PIECE >= len(whole):
            piece = np.concatenate((piece, [_GAP]))
        piece = piece[np.concatenate(([True], (piece[1:] != _GAP) | (piece[:-1] != _GAP)))]
        carried = piece[-2:]
        if len(piece) < 3:
            continue
        codes, counts = np.unique(piece[:-2] << 42 | piece[1:-1] << 21 | piece[2:], return_counts=True)
        if len(whole) > _PIECE:
            found = found or {}
            for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                found[c] = found.get(c, 0) + n
    if found:
        codes = np.fromiter(found, np.int64, len(found))
        counts = np.fromiter(found.values(), np.int64, len(found))
    return codes, counts


class _Table:
    """Vectors of the trigrams seen so far, one row of bytes each; begun anew when it is full."""

    def __init__(self, dimensions: int, most: int = 24_000):
        self.dimensions, self.most = dimensions, most
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.rows = np.zeros((1024, self.dimensions), np.int8)

    def letter(self, symbol: int) -> np.ndarray:
        """The random vector of a letter: -1 and 1, drawn from the letter's own seed."""
        if symbol not in self.letters:
            bits = np.random.default_rng([_SEED, symbol]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[symbol] = bits * np.int8(2) - np.int8(1)
        return self.letters[symbol]

    def gram(self, code: int) -> np.ndarray:
        """The vector of a trigram: its letters' vectors, permuted by place, bound by product."""
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the vectors, each as often as its trigram occurs."""
        total = np.zeros(self.dimensions, np.float64)
        for k in range(0, len(codes), 4096):
            part = codes[k : k + 4096].tolist()
            new = [c for c in part if c not in self.at]
            if len(self.at) + len(new) > self.most:
                self.clear()
                new = part
            for c in new:
                n = self.at[c] = len(self.at)
                if n == len(self.rows):
                    self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                self.rows[n] = self.gram(c)
            rows = self.rows[[self.at[c] for c in part]]
            total += counts[k : k + 4096].astype(np.float32) @ rows.astype(np.float32)
        return total


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The prototype of each language: all trigram vectors of its texts, bundled.

    Each task bundles its own rows, sums go on by language and dimension, and only
    the sums, one vector per language, reach the driver.  Rows with a null text or
    language, and texts without letters, teach nothing.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for batch in batches:
            data, ends = byte_column(batch.column("text"))
            for name, s, e in zip(batch.column("lang").to_pylist(), ends[:-1], ends[1:], strict=True):
                codes, counts = trigrams(data[s:e].tobytes())
                own = sums.setdefault(name, {})
                for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                    own[c] = own.get(c, 0) + n
        table = _Table(dimensions)
        for name, own in sums.items():
            if own:
                total = table.bundle(np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * dimensions),
                        pa.array(np.arange(dimensions, dtype=np.int32)),
                        pa.array(np.rint(total).astype(np.int64)),
                    ],
                    names=["lang", "dim", "part"],
                )

    sums = (
        known.mapInArrow(releasing(each), "lang string, dim int, part bigint")
        .groupBy("lang", "dim")
        .agg(F.sum("part").alias("total"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("dim", "total"))).alias("parts"))
        .limit(MOST_LANGUAGES + 1)
        .collect()
    )
    if len(sums) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {r.lang: np.array([p.total for p in r.parts], np.float64) for r in sums}
    return {k: v / np.linalg.norm(v) for k, v in sorted(out.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``.

    The score is the cosine of the text's bundled trigrams and the nearest prototype,
    0 at least.  Of equally near languages the first by name is taken.  A null text, a
    text without letters, and any text where nothing was learned give ``und`` and 0.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS))
    hidden = spare(docs.columns)
    kept = docs.select(*docs.columns, F.col(text).alias(hidden))
    schema = docs.drop("lang_pred", "score").schema.add("lang_pred", "string").add("score", "double")
    columns = [f.name for f in schema][:-2]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(matrix.shape[1])
        for batch in batches:
            data, ends = byte_column(batch.column(hidden))
            found, scores = [], []
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                codes, counts = trigrams(data[s:e].tobytes())
                best, score = UNKNOWN, 0.0
                if len(codes) and names:
                    own = table.bundle(codes, counts)
                    size = np.linalg.norm(own)
                    cosines = matrix @ own / size if size else np.zeros(len(names))
                    k = int(np.argmax(cosines))
                    best, score = names[k], float(min(1.0, max(0.0, cosines[k])))
                found.append(best)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=[*columns, "lang_pred", "score"],
            )

    return kept.mapInArrow(releasing(each), schema)


def held_out(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``held_out``: every fifth row by the checksum of its id.  A null id is held out."""
    fifth = F.crc32(F.col(key).cast("string")) % 5 == 0
    return docs.withColumn("held_out", F.coalesce(fifth, F.lit(True)))


def predict_languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Learned from the rows that are not held out; neither the language, the source nor
    the id of a row has a part in its prediction.  Repeated rows and columns of other
    names make no difference.
    """
    marked = held_out(docs.select("doc_id", "text", "lang"))
    known = profiles(marked.where("NOT held_out"), dimensions=dimensions)
    return identify(marked.select("doc_id", "text", "held_out"), known).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def keep_known(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, columns unchanged.

    A row goes if no language is found, or if its cosine is within three standard
    deviations of that of unrelated random vectors (``3 / sqrt(dimensions)``).
    """
    known = profiles(held_out(docs.select("doc_id", "text", "lang")).where("NOT held_out"), dimensions=dimensions)
    clear = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(clear)])
    text = f"c{clear.index('text')}"
    judged = identify(safe, known, text).where(
        (F.col("lang_pred") != UNKNOWN) & (F.col("score") > 3 / dimensions**0.5)
    )
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(clear)])
