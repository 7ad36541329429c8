"""License phrases and near license texts, found by an exact containment join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import LOWER, Words, byte_column, chunks, hash_of, spare

THRESHOLD = 0.8

#: Phrases whose words stand side by side, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: License lines; a block that holds enough of a line's distinct words has its label.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

_WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_links bigint"


class Index:
    """Templates as sets of words in one global order, rarest first.

    ``counts`` has the occurrences of each template word in the whole corpus.  A
    block with ``need`` of a template's words has one of its first
    ``size - need + 1``: the prefix.
    """

    def __init__(self, templates, threshold: float, counts: dict[int, int]):
        sets = [sorted({hash_of(w) for w in text.split()}, key=lambda h: (counts.get(h, 0), h)) for _, text in templates]
        self.labels = [label for label, _ in templates]
        self.need = np.array([math.ceil(threshold * len(s) - 1e-9) for s in sets], np.int64)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.vocabulary = np.array(sorted({h for s in sets for h in s}), np.uint64)
        self.rank = np.array([counts.get(int(h), 0) for h in self.vocabulary])
        self.holds = np.zeros((len(self.vocabulary), len(sets)), np.int64)
        self.prefix = np.zeros_like(self.holds, dtype=bool)
        for t, s in enumerate(sets):
            at = np.searchsorted(self.vocabulary, np.array(s, np.uint64))
            self.holds[at, t] = 1
            self.prefix[at[: self.size[t] - self.need[t] + 1], t] = True
        self.starts_any = self.prefix.any(axis=1)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the vocabulary, or -1."""
        low = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[low] == hashes, low, -1)


def _vocabulary_filter(index: Index) -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    table[(index.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    return table


def _in_vocabulary(index: Index, table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that are template words, and their places in the vocabulary."""
    maybe = np.flatnonzero(table[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    place = index.place(hashes[maybe])
    return maybe[place >= 0], place[place >= 0]


def word_counts(docs: DataFrame, text: str, templates=TEMPLATES) -> dict[int, int]:
    """Occurrences of every template word in all texts; one row per word reaches the driver."""
    index = Index(templates, 1.0, {})
    table = _vocabulary_filter(index)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            data, offsets = byte_column(batch.column(0))
            for i, j in chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                words = Words(part, offsets[i : j + 1] - offsets[i], _WORD[part])
                total += np.bincount(_in_vocabulary(index, table, words.hashes(LOWER[part]))[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "n"])

    rows = docs.select(text).mapInArrow(each, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    return {int(index.vocabulary[r.place]): r.n for r in rows.collect()}


def _contained(index: Index, table: np.ndarray, block: np.ndarray, hashes: np.ndarray):
    """Block, template and overlap of every pair that meets the threshold."""
    at, place = _in_vocabulary(index, table, hashes)
    # Prefix filter: only blocks with a word of some template's prefix go on.
    starters = np.unique(block[at[index.starts_any[place]]])
    use = np.isin(block[at], starters)
    pair = np.unique(block[at][use] * len(index.vocabulary) + place[use])
    own, place = np.divmod(pair, len(index.vocabulary))
    if not len(own):
        return own, own, own
    blocks, row = np.unique(own, return_inverse=True)
    # Positional filter: with the block's words in the global order, those from the
    # first prefix word on must be enough.  The words of no template are left out,
    # so this bounds the block's length too.
    order = np.lexsort((index.vocabulary[place], index.rank[place], row))
    row, place = row[order], place[order]
    size = np.bincount(row, minlength=len(blocks))
    position = np.arange(len(row)) - np.concatenate(([0], np.cumsum(size)[:-1]))[row]
    rest = np.zeros((len(blocks), len(index.need)), np.int64)
    k, t = np.nonzero(index.prefix[place])
    np.maximum.at(rest, (row[k], t), size[row[k]] - position[k])
    overlap = np.zeros_like(rest)
    passed = (rest >= index.need).any(axis=1)[row]
    np.add.at(overlap, row[passed], index.holds[place[passed]])
    row, t = np.nonzero((rest >= index.need) & (overlap >= index.need))
    return blocks[row], t, overlap[row, t]


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """All columns of ``docs`` but its own of these names, with the license columns.

    A block is a line.  ``base_labels`` comes from the phrases, ``labels`` also from
    the templates; both are distinct, sorted and comma-joined, empty if none.
    ``score`` is the largest share of a template's words in one block, of those that
    meet the threshold, else 0; ``n_links`` counts these pairs.  A null text is empty.
    Rows stay as they are, repeated ones and null ids too.
    """
    counts = word_counts(docs, "text", templates)
    index = Index(templates, threshold, counts)
    table = _vocabulary_filter(index)
    parts = [(np.array([hash_of(w) for w in p.split()], np.uint64), label) for p, label in phrases.items()]
    new = [c.split(" ")[0] for c in _COLUMNS.split(", ")]
    keep = [c for c in docs.columns if c not in new]
    hidden = spare(keep)
    rows = docs.select(*keep, F.col("text").alias(hidden))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != hidden)

    def chunk(data: np.ndarray, offsets: np.ndarray):
        texts = len(offsets) - 1
        words = Words(data, offsets, _WORD[data])
        hashes = words.hashes(LOWER[data])
        begin = np.searchsorted(words.text, np.arange(texts))
        base = [set() for _ in range(texts)]
        n_base = np.zeros(texts, np.int64)
        first, last = np.full(texts, np.iinfo(np.int64).max), np.full(texts, -1)
        for part, label in parts:
            n = len(hashes) - len(part) + 1
            if n <= 0:
                continue
            at = np.flatnonzero(hashes[:n] == part[0])
            for i in range(1, len(part)):
                at = at[hashes[at + i] == part[i]]
            at = at[words.text[at] == words.text[at + len(part) - 1]]
            home = words.text[at]
            n_base += np.bincount(home, minlength=texts)
            np.minimum.at(first, home, at - begin[home])
            np.maximum.at(last, home, at - begin[home])
            for x in np.unique(home).tolist():
                base[x].add(label)
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        block = lines[words.starts] + words.text  # a text's end ends its last line
        owner, which, overlap = _contained(index, table, block, hashes)
        more = [set(b) for b in base]
        score, links = np.zeros(texts), np.zeros(texts, np.int64)
        if len(owner):
            home = words.text[np.searchsorted(block, owner)]
            np.maximum.at(score, home, overlap / index.size[which])
            np.add.at(links, home, 1)
            for x, t in zip(home.tolist(), which.tolist(), strict=True):
                more[x].add(index.labels[t])
        joined = lambda sets: [",".join(sorted(s)) for s in sets]
        none = last < 0
        return [
            words.counts(), n_base, np.ma.array(first, mask=none), np.ma.array(last, mask=none),
            joined(base), joined(more), score, links,
        ]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(hidden))
            for i, j in chunks(offsets):
                found = chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                arrays = [
                    pa.array(c.data, mask=c.mask) if isinstance(c, np.ma.MaskedArray) else pa.array(c) for c in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in batch.columns[:-1]), *arrays], names=[*keep, *new]
                )

    return rows.mapInArrow(each, schema + _COLUMNS)


def oracle_sql(threshold: float = THRESHOLD, templates=TEMPLATES, phrases=PHRASES) -> str:
    """The same over ``documents``, as plain SQL."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    at = []
    for p, label in phrases.items():
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        at.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    lists = ", ".join(
        f"({t}, '{label}', [{', '.join(repr(w) for w in sorted(set(text.split())))}])" for t, (label, text) in enumerate(templates)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, regexp_extract_all({low.format("text")}, {word}) AS w FROM d),
p AS (SELECT row, unnest(list_concat({", ".join(at)})) AS p FROM w),
base AS (SELECT row, count(*) AS n_base, min(p.at) AS first_word, max(p.at) AS last_word FROM p GROUP BY row),
t(id, label, words) AS (VALUES {lists}),
line AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
block AS (SELECT row, list_distinct(regexp_extract_all({low.format("line")}, {word})) AS words FROM line),
hit AS (SELECT row, label, len(list_intersect(b.words, t.words)) AS overlap, len(t.words) AS size
        FROM block b CROSS JOIN t WHERE len(list_intersect(b.words, t.words)) >= ceil({threshold} * len(t.words) - 1e-9)),
score AS (SELECT row, max(overlap / size) AS score, count(*) AS n_links FROM hit GROUP BY row),
bl AS (SELECT row, string_agg(label, ',' ORDER BY label) AS base_labels
       FROM (SELECT DISTINCT row, p.label AS label FROM p) GROUP BY row),
al AS (SELECT row, string_agg(label, ',' ORDER BY label) AS labels
       FROM (SELECT row, p.label AS label FROM p UNION SELECT row, label FROM hit) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0) AS score, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN base USING (row) LEFT JOIN score USING (row) LEFT JOIN bl USING (row) LEFT JOIN al USING (row)"""
