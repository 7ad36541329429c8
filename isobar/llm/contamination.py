"""Benchmark passages in documents, found by templates with typed slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import use_checkpoints
from . import sketch
from .texts import LOWER, Words, byte_column, chunks, hash_of, range_hashes, spare, windows

WINDOW = 5
COVER = 0.8
#: Words of a window, at least, that are no slots.
PLAIN = 2
#: An item of so many words, but fewer than WINDOW, is one window of its own length.
SHORTEST = 3

#: Words that name a unit when a number stands before them.
UNITS = (
    "mm", "cm", "m", "km", "metre", "metres", "meter", "meters", "kilometre", "kilometres", "kilometer",
    "kilometers", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg",
    "gram", "grams", "kilogram", "kilograms", "ton", "tons", "tonne", "tonnes", "ounce", "ounces", "lb", "lbs",
    "pound", "pounds", "ml", "cl", "l", "litre", "litres", "liter", "liters", "gallon", "gallons", "cup", "cups",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week",
    "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent",
    "degree", "degrees", "mph", "kmh", "watt", "watts", "volt", "volts", "joule", "joules",
)

_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_WORD = _DIGIT | _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_STOP = np.isin(np.arange(256), list(b".!?:;|\""))
_UNIT_HASHES = np.array(sorted(hash_of(u) for u in UNITS), np.uint64)
#: Placeholders: number, unit, name.
_NUM, _UNIT, _NAME = (np.uint64(hash_of(s)) for s in ("<num>", "<unit>", "<name>"))


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case, of A-Z and of the letters from U+00C0 to U+00DE."""
    out = LOWER[data]
    second = np.flatnonzero(data == 0xC3) + 1
    second = second[second < len(data)]
    low = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[low] += 32
    return out


def _upper_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a capital letter stands at these bytes."""
    at = np.minimum(at, len(data) - 1)
    after = data[np.minimum(at + 1, len(data) - 1)]
    return _UPPER[data[at]] | ((data[at] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))


class Template:
    """Tokens of some texts, with numbers, units and names replaced by their type.

    A word is a run of letters and digits; a point or comma between digits belongs
    to it.  A word that begins with a digit is a number; a unit is one of ``UNITS``
    after a number; a name is a capitalised word that does not begin a sentence.  A
    line break ends no sentence.  In ``words`` and ``fixed`` names are words, in lower
    case, whatever their case and place.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        member = _WORD[data]
        if len(data) > 2:
            digit = _DIGIT[data]
            point = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1
            member[point[digit[point - 1] & digit[point + 1]]] = True
        words = Words(data, offsets, member)
        folded = _folded(data)
        self.text = words.text
        self.values = range_hashes(folded, words.starts, words.ends)
        self.tokens = self.values.copy()
        self.words = self.values.copy()
        self.slot = self.fixed = np.zeros(len(words), bool)
        self.counts = words.counts()
        if not len(words):
            return
        number = _DIGIT[data[words.starts]]
        same = np.concatenate(([False], words.text[1:] == words.text[:-1]))
        unit = np.isin(self.values, _UNIT_HASHES) & same & np.concatenate(([False], number[:-1]))
        stops = np.concatenate(([0], np.cumsum(_STOP[data])))
        before = np.concatenate(([0], words.ends[:-1]))
        wide = np.where(data[words.starts] == 0xC3, 2, 1)
        capital = _upper_at(data, words.starts) & (words.ends - words.starts > wide)
        capital &= ~_upper_at(data, words.starts + wide)
        name = capital & same & (stops[words.starts] == stops[before]) & ~number
        for kind, mark in ((number, _NUM), (unit, _UNIT), (name, _NAME)):
            self.tokens[kind] = mark
        self.slot, self.fixed = number | unit | name, number | unit
        self.words[self.fixed] = self.tokens[self.fixed]

    def windows(self, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First tokens, hashes, ids and slots of all windows within a text that have enough plain words.

        First with names as slots, then those with names once more with names as words.
        Both have one id; where only the second has enough plain words, it counts only
        in texts that have no window of the first kind.
        """
        typed, worded = windows(self.tokens, size), windows(self.words, size)
        n = len(typed)
        if not n:
            return []

        def enough(slot: np.ndarray) -> np.ndarray:
            slots = np.concatenate(([0], np.cumsum(slot)))
            return (self.text[:n] == self.text[size - 1 :]) & (slots[size:] - slots[:n] <= size - min(PLAIN, size))

        first, second = enough(self.slot), enough(self.fixed) & (typed != worded)
        has = np.bincount(self.text[:n][first], minlength=len(self.counts)) > 0
        ids = np.where(first, typed, worded)
        out = []
        for good, hashes, slot in ((first, typed, self.slot), (second, worded, self.fixed)):
            at = np.flatnonzero(good)
            out.append((at, hashes[at], np.where(first[at] | ~has[self.text[at]], ids[at], np.uint64(0)), slot))
        return out


_WINDOWS = "pos int, win bigint, id bigint, size int, words int, slots array<bigint>"


def template_windows(rows: DataFrame, keys: list[str], text: str, sizes: list[int], known: np.ndarray | None) -> DataFrame:
    """``keys``, token position, hash, id, length, words of the text and slot values of the windows of every text.

    With a bitmap ``known`` only windows that may be in it leave the task, of all
    ``sizes``, and those without slots leave once per text.  Without one, texts that
    are shorter than the largest size are one window, if that has one of the ``sizes``.
    """
    hidden = spare(keys)
    kept = rows.select(*keys, F.col(text).alias(hidden))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema if f.name != hidden)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(hidden))
            for i, j in chunks(offsets):
                template = Template(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for size in sizes:
                    for found in template.windows(size):
                        yield made(batch, i, j, template, size, *found)

    def made(batch, i, j, template, size, at, hashes, ids, slot):
        if known is not None:
            hit = sketch.found(known, hashes)
        else:
            words = template.counts[template.text[at]]
            hit = (ids != 0) & ((words == size) if size < max(sizes) else (words >= size))
        at, hashes, ids = at[hit], hashes[hit], ids[hit]
        slots = np.concatenate(([0], np.cumsum(slot)))
        begin, end = slots[at], slots[at + size]
        if known is not None and len(at):
            pair = np.stack((template.text[at], hashes.view(np.int64)), axis=1)
            once = np.zeros(len(at), bool)
            once[np.unique(pair, axis=0, return_index=True)[1]] = True
            keep = once | (end > begin)
            at, hashes, ids, begin, end = at[keep], hashes[keep], ids[keep], begin[keep], end[keep]
        values = template.values[slot].view(np.int64)
        width = end - begin
        ends = np.concatenate(([0], np.cumsum(width)))
        flat = np.repeat(begin - ends[:-1], width) + np.arange(ends[-1])
        first = np.searchsorted(template.text, np.arange(j - i))
        own = template.text[at]
        return pa.RecordBatch.from_arrays(
            [
                *(c.take(pa.array(own + i)) for c in batch.columns[:-1]),
                pa.array((at - first[own]).astype(np.int32)),
                pa.array(hashes.view(np.int64)),
                pa.array(ids.view(np.int64)),
                pa.array(np.full(len(at), size, np.int32)),
                pa.array(template.counts[own].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[flat])),
            ],
            names=[*keys, *(c.split(" ")[0] for c in _WINDOWS.split(", "))],
        )

    return kept.mapInArrow(each, schema + _WINDOWS)


def _occurrences() -> Column:
    """The groups in which the values of a match must agree with those of others.

    All matches of the document; those of one offset; and those of offsets that lie
    together, in two rows of ranges as wide as the item, set off by half of it.
    """
    offset = (F.col("pos") - F.col("item_pos")).cast("bigint")
    half = F.floor(F.col("words") / 2)
    places = (F.lit(0), offset, F.floor(offset / F.col("words")), F.floor((offset + half) / F.col("words")))
    return F.array(*[F.struct(F.lit(k).alias("k"), p.cast("bigint").alias("at")) for k, p in enumerate(places)])


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, cover: float = COVER) -> DataFrame:
    """``doc_id, text_hash, item_id, covered, windows, changed`` of every passage found.

    A document holds an item if at least ``cover`` of the item's distinct template
    windows are in it with consistent slots: each value of the item stands for the
    value it most often stands for, and windows that disagree do not count.  That is
    settled in every occurrence of its own (see ``_occurrences``), and the one that
    covers most counts; windows without slots count wherever they stand.  A window
    with names also counts if its words are the item's, whatever their case and
    place in a sentence.  ``changed`` counts the values that differ.

    An item of SHORTEST words or more, but fewer than ``size``, is one window.  Items
    with a null id or text, or of fewer words, and windows of almost only slots are
    never found; nor is anything in a null or shorter text.  Rows of one id and text
    give one result.  Items with one id are one item.

    The windows of the documents meet a bitmap of fixed size before anything is
    shuffled; what passes is joined with the items' windows by hash.
    """
    use_checkpoints(docs.sparkSession)
    sizes = list(range(min(SHORTEST, size), size + 1))
    item_windows = template_windows(items.where("item_id IS NOT NULL"), ["item_id"], "text", sizes, None)
    item_windows = item_windows.withColumnsRenamed({"slots": "item_slots", "pos": "item_pos"})
    # The bitmap, the join and the totals read them; a benchmark is small beside a corpus.
    known = sketch.bitmap(item_windows, "win")
    used = sorted(r["size"] for r in item_windows.select("size").distinct().collect())
    totals = item_windows.groupBy("item_id").agg(F.countDistinct("id").alias("windows"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = template_windows(keyed, ["doc_id", "text_hash"], "text", used, known).drop("id", "size", "words")
    pair = ["doc_id", "text_hash", "item_id"]
    # Stored: three branches read them, and the texts should be read once.
    matches = found.join(item_windows, "win").select(
        *pair, "id", "win", "item_pos", "pos", "words", "slots", "item_slots"
    ).checkpoint()
    slotted = (
        matches.where("size(slots) > 0 AND size(slots) = size(item_slots)")
        .select(*pair, "id", "win", "item_pos", "pos", "slots", "item_slots", F.explode(_occurrences()).alias("o"))
        .select(*pair, "id", "win", "item_pos", "pos", "o", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
        .select(*pair, "id", "win", "item_pos", "pos", "o", F.col("s.item_slots").alias("ours"), F.col("s.slots").alias("theirs"))
    )
    within = [*pair, "o"]
    safe = [F.col(c).eqNullSafe(F.col(f"m_{c}")) if c == "doc_id" else F.col(c) == F.col(f"m_{c}") for c in within]
    meaning = (
        slotted.groupBy(*within, "ours", "theirs")
        .count()
        .groupBy(*within, "ours")
        .agg(F.max_by("theirs", F.struct("count", "theirs")).alias("theirs"))
        .select(*[F.col(c).alias(f"m_{c}") for c in (*within, "ours", "theirs")])
    )
    agreeing = (
        slotted.join(meaning, [*safe, F.col("ours") == F.col("m_ours")])
        .groupBy(*within, "id", "win", "item_pos", "pos")
        .agg(F.bool_and(F.col("theirs") == F.col("m_theirs")).alias("agrees"), F.count_if(F.col("ours") != F.col("theirs")).alias("changed"))
        .where("agrees")
        .select(*pair, "id", "o", "changed")
    )
    # A window may count as plain, by its own names, and in an occurrence.
    fixed = matches.where("size(slots) = 0").select(*pair, "id").distinct()
    by_window = agreeing.groupBy(*within, "id").agg(F.max("changed").alias("changed"))
    mine = [by_window[c].eqNullSafe(fixed[c]) if c == "doc_id" else by_window[c] == fixed[c] for c in (*pair, "id")]
    best = (
        by_window.join(fixed, mine, "left_anti")
        .groupBy(*within)
        .agg(F.count("*").alias("covered"), F.max("changed").alias("changed"))
        .groupBy(*pair)
        .agg(F.max(F.struct("covered", (-F.col("changed")).alias("same"))).alias("b"))
        .select(*pair, F.col("b.covered").alias("covered"), (-F.col("b.same")).alias("changed"))
    )
    return (
        fixed.groupBy(*pair)
        .agg(F.count("*").alias("covered"), F.lit(0).cast("bigint").alias("changed"))
        .union(best)
        .groupBy(*pair)
        .agg(F.sum("covered").alias("covered"), F.max("changed").alias("changed"))
        .join(totals, "item_id")
        .where(F.col("covered") >= cover * F.col("windows"))
        .select(*pair, "covered", "windows", "changed")
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; columns unchanged, null ids and repeated rows kept."""
    bad = contaminated(docs, items).select("text_hash").distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["text_hash"], "left_anti")
