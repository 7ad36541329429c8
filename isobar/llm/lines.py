"""Removal of repeated and nearly repeated lines by an exact set-similarity join."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import partial
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from . import sketch
from .texts import LOWER, SPACES, byte_column, chunks, mixed, range_hashes, releasing, spare

#: Lines match if the Jaccard similarity of their word sets is at least this fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Word counts are kept for so many hash values; a fixed size whatever the data.
COUNT_BITS = 22
#: Counts that travel together, and the tasks that add up each slice at first.
SLICE = 4096
SPREAD = 16
#: In each list a line is held against so many lines before it, and the list's first.
NEAR = 1024
#: So many of them at most, the nearest, are compared by their words at first.  Lines
#: with more that are still unmatched are held against all ``NEAR``; those beyond in a
#: longer list go through the parts of it that share a second word with them too.
FIRST = 8

KEY = ["kid", "th", "line"]
#: What lists carry of a key: lists are the bulk of the work, and the words that are
#: looked up later bring the text hash back.
SHORT = ["kid", "line"]
#: Stands for no word before in arrays, where words are 32-bit hashes.
_NONE = 1 << 40
_MEMBER, _LOWER = (~SPACES).astype(np.uint8).tobytes(), LOWER.tobytes()
#: Words of more bytes than this are hashed by ``range_hashes``.
LONG_WORD = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: The first so many of eight bytes, by number.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_POSTING = ("token", *SHORT, "size", "pos", "prev", "bits")
#: What sets have to share by their number of differing bits.
_TIMES = (NUMERATOR + DENOMINATOR) * np.arange(65)
#: Batches of lists that are gone through at once.
TOGETHER = 16
#: The bit map of a set of more words than this is of little use; half of its words have
#: one of their own, ``half``, which leaves the other half's in ``bits`` without it.
MAPPED = 64
#: Columns of hashes, of which few are equal.
_HASHED = ("h1", "h2", "bits", "half", "prefix.list.element")
#: Columns that lists may carry besides.
_MORE = ("half", "asked")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """A document is its id and text; a null id comes before all others."""
    kid = F.coalesce("doc_id", F.lit(-(2**63))).alias("kid")
    return docs.select(kid, F.xxhash64("text").alias("th"), F.col("text").alias("_text"), *more)


def _word_places(text: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a word ends with its text."""
    member = np.zeros(len(text) + 2, bool)
    member[1:-1] = np.frombuffer(text.translate(_MEMBER), bool)
    starts, ends = np.flatnonzero(member[1:] > member[:-1]), np.flatnonzero(member[1:] < member[:-1])
    inner = np.unique(offsets[1:-1])
    joints = inner[member[inner] & member[inner + 1]]
    if len(joints):  # both an end and a start
        starts, ends = (np.insert(x, np.searchsorted(x, joints), joints) for x in (starts, ends))
    return starts, ends


def _word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased, from eight of its bytes at a time."""
    data = np.frombuffer(text.translate(_LOWER) + bytes(8), np.uint8)
    eights = np.ndarray((len(text) + 1,), "<u8", data, strides=(1,))
    size = ends - starts
    hashes = mixed((eights[starts] & _BYTES[np.minimum(size, 8)]) * _FACTOR + size.astype(np.uint64))
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    for done in range(8, LONG_WORD, 8):
        more = more[size[more] > done]
        if not len(more):
            break
        next_ones = eights[starts[more] + done] & _BYTES[np.minimum(size[more] - done, 8)]
        hashes[more] = mixed(hashes[more] * _FACTOR + next_ones)
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        words = np.concatenate([data[i:j] for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        until = np.cumsum(size[long])
        hashes[long] = range_hashes(words, until - size[long], until)
    return hashes


def word_ranks(docs: DataFrame) -> np.ndarray:
    """How frequent words are, by the lowest bits of the word's hash: eight steps for each doubling.

    0 stands for words that occur once or never.  A task counts all its rows and passes on
    slices of the table, of which it lists the counts that are not zero; slices are added up
    in a few rows' memory, and one table of fixed size, a byte an entry, reaches the driver.
    """

    def packed(slices: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for some in batched(slices, 256):
            numbers, parts = [], []
            for i, part in some:
                at = np.flatnonzero(part)
                if len(at):
                    numbers.append(i)
                    parts.append(at.astype(np.uint16).tobytes() + part[at].astype(np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint64)
        for batch in batches:
            data, offsets = byte_column(batch.column(0))
            for i, j in chunks(offsets):
                text = data[offsets[i] : offsets[j]].tobytes()
                hashes = _word_hashes(text, *_word_places(text, offsets[i : j + 1] - offsets[i]))
                at, n = np.unique(hashes.astype(np.uint32) & np.uint32(len(total) - 1), return_counts=True)
                total[at] += n.astype(np.uint64)
        yield from packed(enumerate(total.reshape(-1, SLICE)))

    def summed(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                buffer = part.as_buffer()
                n = buffer.size // 10
                here = sums.setdefault(i, np.zeros(SLICE, np.uint64))
                here[np.frombuffer(buffer, np.uint16, n)] += np.frombuffer(buffer[2 * n :].to_pybytes(), np.uint64)
        return sums

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(summed(batches).items())

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = summed(batches)
        steps = [np.minimum(np.log2(np.maximum(x, 1)) * 8, 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(steps, pa.binary())], names=["slice", "ranks"]
        )

    kind = "slice int, counts binary"
    # Two steps, so that no task gets a slice from every other task.
    spread = docs.select("text").mapInArrow(releasing(count), kind).repartition("slice", F.spark_partition_id() % SPREAD)
    rows = spread.mapInArrow(releasing(add), kind).repartition("slice").mapInArrow(releasing(rank), "slice int, ranks binary").toArrow()
    out = np.zeros(((1 << COUNT_BITS) // SLICE, SLICE), np.uint8)
    for i, part in zip(rows["slice"].to_pylist(), rows["ranks"], strict=True):
        out[i] = np.frombuffer(part.as_buffer(), np.uint8)
    return out.reshape(-1)


def line_sets(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """Every line with a word: its key, 128-bit set hash, size, bit map and prefix.  And each row of ``docs``, as line -1.

    Words are put in one global order, rarest first by ``rank``.  Two sets that
    match share a word of their prefixes, and another one within one word more, which
    ``prefix`` ends with.  Words of rank 0 stand in one line only, so no two sets share
    them: ``prefix`` leaves them out, and ``lone`` tells how many they are.  Sets of up to
    three words match only their equals and get no prefix; nor do sets whose prefix has
    no word but lone ones before its last.  A bit of the map tells whether an odd number
    of the set's words have its hash value; ``half`` is the map of about half of the words
    if they are more than ``MAPPED``, else 0.  ``times`` is how often the set stands in the
    texts that were taken together, at the first of these lines, and 0 at the others.
    Line -1 has the number of its text's lines as ``size``, and ``lone`` is 1 if it has no id.
    """
    kind = "kid bigint, th bigint, line int, h1 bigint, h2 bigint, times int, size int, bits bigint, half bigint, lone int, prefix array<int>"
    names = [part.split()[0] for part in kind.split(", ")]

    def chunk(kid: np.ndarray, th: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        text = data.tobytes()
        starts, ends = _word_places(text, offsets)
        hashes = _word_hashes(text, starts, ends)
        # The text of each word, and how many line feeds stand before it.
        home = np.repeat(np.arange(len(kid)), np.diff(np.searchsorted(starts, offsets)))
        feeds = np.flatnonzero(data == 10)
        breaks = np.repeat(np.arange(len(feeds) + 1), np.diff(np.searchsorted(starts, feeds), prepend=0, append=len(starts)))
        line = breaks + home
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        first, dense = np.flatnonzero(new), np.cumsum(new) - 1
        home = home[first]
        number = breaks[first] - np.searchsorted(feeds, offsets)[home]
        rarity = rank[(hashes & np.uint64(len(rank) - 1)).astype(np.int64)].astype(np.uint64)
        if len(first) < 1 << 15:
            order = np.argsort(dense.astype(np.uint64) << np.uint64(49) | rarity << np.uint64(40) | hashes >> np.uint64(24))
        else:
            order = np.lexsort((hashes >> np.uint64(24), rarity, dense))
        row, hashes, rarity = dense[order], hashes[order], rarity[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        row, hashes, rarity = row[new], hashes[new], rarity[new]
        size = np.bincount(row, minlength=len(first))
        begin = np.concatenate(([0], np.cumsum(size)))
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h))) for h in (hashes, mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))]
        h1, h2 = ((s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums)
        each_bit = np.uint64(1) << (hashes >> np.uint64(58))
        bits = np.bitwise_xor.reduceat(each_bit, begin[:-1]) if len(first) else hashes
        each_bit *= hashes >> np.uint64(57) & np.uint64(1)
        half = np.where(size > MAPPED, np.bitwise_xor.reduceat(each_bit, begin[:-1]), np.uint64(0)) if len(first) else hashes
        least = -(-size * NUMERATOR // DENOMINATOR)
        prefix = np.where(size > 3, size - least + 2, 0)
        lone = np.minimum(np.bincount(row[rarity == 0], minlength=len(first)), prefix)
        prefix = np.where(prefix - lone > 1, prefix - lone, 0)
        ends = np.concatenate(([0], np.cumsum(prefix)))
        flat = np.repeat(begin[:-1] + lone - ends[:-1], prefix) + np.arange(ends[-1])
        kid, th = kid[home], th[home]
        equal = np.lexsort((number, th, kid, h2, h1))
        begins = np.flatnonzero(np.concatenate(([True], (h1[equal[1:]] != h1[equal[:-1]]) | (h2[equal[1:]] != h2[equal[:-1]])))[: len(equal)])
        times = np.zeros(len(equal), np.int32)
        times[equal[begins]] = np.diff(begins, append=len(equal))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kid), pa.array(th), pa.array(number.astype(np.int32)), pa.array(h1), pa.array(h2), pa.array(times),
                pa.array(size.astype(np.int32)), pa.array(bits.view(np.int64)), pa.array(half.view(np.int64)), pa.array(lone.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((hashes[flat] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))),
            ],
            names=names,
        )

    def rows(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        n_lines = np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets)) + 1
        n_lines[batch.column("_text").is_null().to_numpy(zero_copy_only=False)] = 0
        zero, none = pa.array(np.zeros(len(n_lines), np.int64)), pa.array(batch.column("no_id").cast(pa.int32()))
        have = {"line": pa.array(np.full(len(n_lines), -1, np.int32)), "size": pa.array(n_lines.astype(np.int32)), "lone": none}
        have |= {c: batch.column(c) for c in ("kid", "th")} | {c: zero for c in ("h1", "h2", "bits", "half")}
        have |= {"times": zero.cast(pa.int32()), "prefix": pa.nulls(len(n_lines), pa.list_(pa.int32()))}
        return pa.RecordBatch.from_arrays([have[c] for c in names], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kid, th = batch.column("kid").to_numpy(), batch.column("th").to_numpy()
            data, offsets = byte_column(batch.column("_text"))
            yield rows(batch, data, offsets)
            for i, j in chunks(offsets):
                yield chunk(kid[i:j], th[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    return _keyed(docs, F.col("doc_id").isNull().alias("no_id")).mapInArrow(releasing(each), kind)


def _postings(sets: DataFrame) -> DataFrame:
    """A row for each prefix word of each set, with its place, the word before it if others may hold that, and all words of the prefix."""
    listed = sets.select(*SHORT, "size", "bits", "half", "lone", "prefix", F.posexplode("prefix").alias("at", "token"))
    before = F.when(F.col("at") > 0, F.col("prefix")[F.col("at") - 1])
    place = (F.col("at") + F.col("lone")).alias("pos")
    return listed.where(F.col("at") < F.size("prefix") - 1).select(
        "token", *SHORT, "size", place, before.alias("prev"), "bits", "half", "at", "prefix"
    )


def _sorted_lists(postings: DataFrame) -> DataFrame:
    """Lists sorted by word and key, each in one partition.

    Rows travel and are sorted packed.  ``head``, a word and its key's id as far as that
    fits into 32 bits, nearly always tells two rows apart.
    """
    word, within = F.col("token").cast("bigint"), F.least(F.greatest("kid", F.lit(0)), F.lit((1 << 32) - 1))
    two = lambda a, b: F.shiftleft(F.col(a).cast("bigint"), 32).bitwiseOR(F.col(b).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1)))
    # No word before is told by the sign.
    before = F.when(F.col("prev").isNull(), F.shiftleft(F.col("pos").cast("bigint"), 32).bitwiseOR(F.lit(-(1 << 63)))).otherwise(two("pos", "prev"))
    rows = postings.select(
        F.shiftleft(word, 32).bitwiseOR(within).alias("head"), "kid", two("line", "size").alias("sized"), before.alias("before"), "bits", "half"
    )
    high, low = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.shiftright(F.shiftleft(c, 32), 32).cast("int")
    rows = rows.repartition(high("head")).sortWithinPartitions("head", "kid", "sized")
    return rows.select(
        high("head").alias("token"), "kid", high("sized").alias("line"), low("sized").alias("size"),
        high("before").bitwiseAND(F.lit((1 << 31) - 1)).alias("pos"),
        F.when(F.col("before") >= 0, low("before")).alias("prev"), "bits", "half",
    )


def _fits(n, m, i, j, unlike):
    """Length, positional and bit map filter for sets of ``n`` and ``m`` words that share the words at ``i`` and ``j``.

    Works on arrays and on columns.  At the first word that two sets share, the rest
    of either set bounds what else they share.  Of ``unlike`` differing bits each
    needs a word that only one of the sets has.
    """
    total = NUMERATOR + DENOMINATOR
    return (
        (DENOMINATOR * m >= NUMERATOR * n)
        & (DENOMINATOR * n >= NUMERATOR * m)
        & (total * (n - i) >= NUMERATOR * (n + m))
        & (total * (m - j) >= NUMERATOR * (n + m))
        & (total * (n + m - unlike) >= 2 * NUMERATOR * (n + m))
    )


def _near_candidates(batches: Iterator[pa.RecordBatch], again: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs from lists sorted by word and key; of a list only its first line and the last ``NEAR`` are held.

    A pair whose words before the shared one are equal too was found there, and is
    passed over.  A line with more than ``FIRST`` pairs, or beyond ``NEAR`` in its list,
    also comes out with the list's word instead of a partner, and whether it is ``far``.
    When a list is gone through ``again``, lines that are ``asked`` for come with all
    their pairs among the last ``NEAR``, and no others come.
    """
    most = NEAR if again else FIRST
    held: dict[str, np.ndarray] = {}  # the first row of the open list, then its last ones
    rank = 0  # place in its list of the row after the held ones
    for batch in map(pa.Table.from_batches, batched(batches, TOGETHER)):
        columns = [c for c in (*_POSTING, *_MORE) if c in batch.schema.names]
        new = {c: batch.column(c).cast(pa.int64()).fill_null(_NONE).to_numpy() for c in columns}
        rows = {c: np.concatenate((held[c], new[c])) if held else new[c] for c in columns}
        token, size, bits = rows["token"], rows["size"], rows["bits"]
        half = rows.get("half", np.zeros_like(bits))
        known = len(token) - batch.num_rows
        fresh = np.arange(known, len(token))
        if not len(fresh):
            continue
        begins = np.concatenate(([True], token[1:] != token[:-1]))
        start = np.maximum.accumulate(np.where(begins, np.arange(len(token)), 0))
        here = np.arange(len(token)) - start  # rows of its list that are at hand before each
        place = here.copy()
        if known:
            place[start == 0] += rank - known
        # The held first row may not stand right before the last ones: no neighbour by distance.
        skipped = known > 1 and rank > known

        def differing(a: np.ndarray, b: np.ndarray, size=size, bits=bits, half=half) -> np.ndarray:
            whole = bits[a] ^ bits[b]
            unlike = np.bitwise_count(whole.view(np.uint64)).astype(np.int64)
            wide = np.flatnonzero((size[a] > MAPPED) & (size[b] > MAPPED))
            parts = half[a[wide]] ^ half[b[wide]]
            for x in (parts, whole[wide] ^ parts):
                unlike[wide] += np.bitwise_count(x.view(np.uint64))
            unlike[wide] -= np.bitwise_count(whole[wide].view(np.uint64))
            return unlike

        plain = bits.view(np.uint64)
        # Of both sizes together, so much may differ for each of the pair.
        spared = (NUMERATOR + DENOMINATOR - 2 * NUMERATOR) * size

        def fit(a: np.ndarray, b: np.ndarray, rows=rows, size=size, plain=plain, spared=spared, differing=differing) -> np.ndarray:
            # The one map first, which leaves out nearly all pairs.
            at = np.flatnonzero(spared[a] + spared[b] >= _TIMES[np.bitwise_count(plain[a] ^ plain[b])])
            a, b = a[at], b[at]
            same_before = (rows["prev"][a] == rows["prev"][b]) & (rows["prev"][a] != _NONE)
            return at[~same_before & _fits(size[a], size[b], rows["pos"][a], rows["pos"][b], differing(a, b))]

        pairs = np.zeros(len(token), np.int64)
        later, earlier = [], []
        active = fresh[place[fresh] > 0]
        if again:
            active = active[rows["asked"][active] == 1]
        for d in range(1, NEAR + 1):
            active = active[here[active] >= d]
            if not len(active):
                break
            use = active[active - d > 0] if skipped else active
            good = use[fit(use, use - d)]
            pairs[good] += 1
            if len(good):
                good = good[pairs[good] <= most]
                later.append(good)
                earlier.append(good - d)
                active = active[pairs[active] <= most]
        far = fresh[(place[fresh] > NEAR) & (not again)]
        good = far[fit(far, start[far])]
        a, b = np.concatenate((*later, good)).astype(np.int64), np.concatenate((*earlier, start[good])).astype(np.int64)
        more = np.union1d(far, fresh[pairs[fresh] > most]).astype(np.int64)
        flag = np.concatenate((np.zeros(len(a), bool), np.ones(len(more), bool)))
        unlike = differing(a, b).astype(np.int32)
        kinds = {"line": pa.int32(), "kid": pa.int64()}
        ours = [pa.array(rows[c][np.concatenate((a, more))]).cast(kinds[c]) for c in SHORT]
        theirs = [pa.array(np.concatenate((rows[c][b], np.zeros(len(more), np.int64))), mask=flag).cast(kinds[c]) for c in SHORT]
        words = pa.array(np.concatenate((np.zeros(len(a), np.int64), token[more])), mask=~flag).cast(pa.int32())
        unlike = pa.array(np.concatenate((unlike, np.zeros(len(more), np.int32))), mask=flag)
        beyond = pa.array(np.concatenate((np.zeros(len(a), bool), place[more] > NEAR)), mask=~flag)
        names = [*SHORT, *(f"y_{c}" for c in SHORT), "token", "unlike", "far"]
        yield pa.RecordBatch.from_arrays([*ours, *theirs, words, unlike, beyond], names=names)
        open_list = np.flatnonzero(token == token[-1])
        rank = int(place[-1]) + 1
        keep = open_list if len(open_list) <= NEAR + 1 else np.concatenate((open_list[:1], open_list[-NEAR:]))
        held = {c: rows[c][keep] for c in columns}


_PAIR = "kid bigint, line int, y_kid bigint, y_line int, token int, unlike int, far boolean"


def _line_words(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``kid, th, line, low, n`` of the needed lines, from a second reading of the texts.

    ``low`` holds each of the line's ``n`` words once, A-Z lower-cased, a space between two.
    A bitmap of fixed size leaves out nearly all other lines; the join drops the rest.
    """
    known = sketch.bitmap(needed.select(F.shiftleft("kid", 5).bitwiseXOR(F.col("line").cast("bigint")).alias("at")), "at")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kid, th = batch.column("kid").to_numpy(), batch.column("th").to_numpy()
            data, offsets = byte_column(batch.column("_text"))
            out = ([], [], [], [], [])
            # A line begins with its text, or behind a line feed.
            feeds = np.flatnonzero(data == 10)
            begins = np.concatenate((offsets[:-1], feeds + 1))
            ends = np.concatenate((feeds, offsets[1:]))
            begins.sort()
            ends.sort()
            rows = np.arange(len(kid))
            before = np.searchsorted(feeds, offsets)
            row = np.repeat(rows, np.diff(before) + 1)
            number = np.arange(len(row)) - before[row] - row
            wanted = np.flatnonzero(sketch.found(known, kid[row].view(np.uint64) << np.uint64(5) ^ number.astype(np.uint64)))
            for k, i, first, last in zip(*(x[wanted].tolist() for x in (row, number, begins, ends)), strict=True):
                words = dict.fromkeys(LOWER[data[first:last]].tobytes().split())  # of bytes: at ASCII space only
                low = b" ".join(words).decode("utf-8", "replace")
                for column, value in zip(out, (kid[k], th[k], i, low, len(words)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[*KEY, "low", "n"]
            )

    return _keyed(docs).mapInArrow(releasing(each), "kid bigint, th bigint, line int, low string, n int")


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the pairs whose words, ``low`` and ``y_low``, reach the similarity."""
    for batch in batches:
        both = np.zeros(batch.num_rows, np.int64)
        words, others = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("low", "y_low"))
        for i, (ours, theirs) in enumerate(zip(words, others, strict=True)):
            both[i] = len(set(ours.split(b" ")).intersection(theirs.split(b" ")))
        sizes = batch.column("n").to_numpy().astype(np.int64) + batch.column("y_n").to_numpy()
        yield batch.select(KEY).filter(pa.array((NUMERATOR + DENOMINATOR) * both >= NUMERATOR * sizes))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys of the lines that reach the similarity with the line before that they are paired with."""
    y_short, y_key = [f"y_{c}" for c in SHORT], [f"y_{c}" for c in KEY]
    pairs = _stored(pairs.select(*SHORT, *y_short).distinct())
    needed = pairs.select(*SHORT).union(pairs.select(*y_short)).distinct()
    texts = _stored(_line_words(docs, needed).join(needed, SHORT, "left_semi").dropDuplicates(KEY))
    theirs = texts.withColumnsRenamed({c: f"y_{c}" for c in (*KEY, "low", "n")})
    found = pairs.join(texts, SHORT).join(theirs, y_short).where(F.struct(*y_key) < F.struct(*KEY))
    return found.select(*KEY, "low", "n", "y_low", "y_n").mapInArrow(releasing(_reaching), "kid bigint, th bigint, line int")


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; packed, unlike a checkpoint."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/lines-{uuid.uuid4().hex}"
    # Dictionaries of hashes are built in vain.
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in _HASHED}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within, the setting has this value."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _shuffles_end(spark: SparkSession):
    """Within, a query's shuffle files go when it ends; else they stay until the driver collects its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def _rows_alone(spark: SparkSession):
    """Within, a batch for Python ends by its number of rows alone; its bytes are else added up again for every row.

    Only for rows of a fixed width.
    """
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1))


def removed_lines(docs: DataFrame) -> DataFrame:
    """``kid, th, removed``: the numbers of the lines that go, of each document that loses any.

    Lines are ordered by document id, then text hash, then line number.  A line goes
    if any line before it has an equal set of words or one of Jaccard similarity 0.8
    or more, whether that line itself stays or goes.

    Equal sets are one set, which its first line stands for.  Lists by prefix word
    give candidate pairs that pass the length, positional and bit map filters; their
    words are then compared.  In a list, a line is held against its near predecessors,
    and of those that pass only the nearest are listed, of which the one most alike is
    compared first.  That settles large families of similar lines without their pairs;
    lines that are still unmatched are compared with the others listed.  Those that had
    more are also held against all near predecessors, and those that stand far on in a
    long list meet its lines that share the next word of the prefix with them.
    """
    return _removed(docs)[0]


def _removed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``removed_lines`` and every row of ``docs``, as line -1 of ``line_sets``."""
    with _shuffles_end(docs.sparkSession):
        stored = _stored(line_sets(docs, word_ranks(docs)))
        lines, rows = stored.where("line >= 0"), stored.where("line < 0")
        first = F.min(F.struct(*KEY, "size", "bits", "half", "lone", "prefix")).alias("f")
        # Copies were added up where they stand together, so few are left to add up before the exchange.
        sets = lines.where("times > 0").repartition("h1", "h2").groupBy("h1", "h2")
        sets = sets.agg(first, (F.sum("times") > 1).alias("copied"))
        sets = _stored(sets.select("h1", "h2", "f.*", "copied"))
        matched = _matched(docs, rows, sets)

    copied = sets.where("copied").select("h1", "h2", F.struct(*KEY).alias("first"))
    others = lines.select(*KEY, "h1", "h2").join(copied, ["h1", "h2"]).where(F.struct(*KEY) != F.col("first"))
    gone = others.select(*KEY).union(matched)
    return gone.groupBy("kid", "th").agg(F.sort_array(F.collect_set("line")).alias("removed")), rows


def _matched(docs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Keys of the sets that reach the similarity with a set before."""
    pair, key = [*SHORT, *(f"y_{c}" for c in SHORT)], F.struct(*SHORT)
    postings = _postings(sets.where("size(prefix) > 0"))
    with _rows_alone(docs.sparkSession):
        found = _stored(_sorted_lists(postings).mapInArrow(releasing(_near_candidates), _PAIR))
    listed = found.where("token IS NULL")
    best = listed.groupBy(*SHORT).agg(F.min(F.struct("unlike", "y_kid", "y_line")).alias("best"))
    matched = _stored(_verified(docs, best.select(*SHORT, "best.y_kid", "best.y_line")).distinct())
    # Ids that stand for several texts: their short keys do not tell lines apart.
    twins = rows.select("kid", "th").distinct().groupBy("kid").count().where("count > 1")
    twins = _stored(twins.select("kid", F.lit(True).alias("twin")))
    settled = _stored(matched.select(*SHORT).distinct().join(twins, "kid", "left_anti"))
    rest = listed.select(*pair).join(settled, SHORT, "left_anti")
    # Stored, so that their size is known when the lists are joined with them.
    left = found.where("token IS NOT NULL").select("token", *SHORT, "far").join(settled, SHORT, "left_anti")
    left = _stored(left.groupBy("token", *SHORT).agg(F.max("far").alias("far")))
    tokens = _stored(left.groupBy("token").agg(F.max("far").alias("long")))
    long = {r.long for r in tokens.select("long").distinct().collect()}
    if long:
        asked = left.select("token", *SHORT, F.lit(True).alias("asked"))
        lists = postings.drop("at", "prefix").join(tokens.select("token"), "token").join(asked, ["token", *SHORT], "left")
        lists = lists.withColumn("asked", F.coalesce("asked", F.lit(False)))
        lists = lists.repartition("token").sortWithinPartitions("token", *SHORT)
        rest = rest.union(lists.mapInArrow(releasing(partial(_near_candidates, again=True)), _PAIR).select(*pair))
    if True in long:
        # The two rarest words that sets share stand in both prefixes, one behind the other.
        behind = F.filter("prefix", lambda word, place: place > F.col("at"))
        parts = postings.join(tokens.where("long").select("token"), "token").withColumn("second", F.explode(behind))
        parts = _stored(parts.drop("at", "prefix").join(twins, "kid", "left"))
        ours = parts.join(left.where("far"), ["token", *SHORT], "left_semi")
        theirs = parts.drop("twin").withColumnsRenamed({c: f"y_{c}" for c in (*_POSTING, "half") if c != "token"})
        y_key = F.struct(*[f"y_{c}" for c in SHORT])
        before = (y_key < key) | ((y_key == key) & F.col("twin").isNotNull())
        same_before = F.coalesce(F.col("prev") == F.col("y_prev"), F.lit(False))
        whole, half = (F.col(c).bitwiseXOR(F.col(f"y_{c}")) for c in ("bits", "half"))
        parted = F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))
        unlike = F.when((F.col("size") > MAPPED) & (F.col("y_size") > MAPPED), parted).otherwise(F.bit_count(whole))
        fits = _fits(*[F.col(c) for c in ("size", "y_size", "pos", "y_pos")], unlike)
        far = ours.join(theirs, ["token", "second"]).where(before & ~same_before & fits)
        rest = rest.union(far.select(*pair))
    return _stored(matched.union(_verified(docs, rest)).distinct())


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed_lines`` of every row.

    Line numbers count from 0 and are comma-joined.  Lines without words never
    match.  A null text has no lines; equal rows lose the same lines.
    """
    removed, rows = _removed(docs)
    doc_id = F.when(F.col("lone") == 0, F.col("kid")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    # Lines were counted where the texts were split, so no text is read again.
    rows = rows.select("kid", "th", doc_id, F.col("size").cast("bigint").alias("n_lines")).join(removed, ["kid", "th"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select(
        "doc_id",
        "n_lines",
        F.size(removed).cast("bigint").alias("n_removed"),
        F.array_join(F.transform(removed, lambda x: x.cast("string")), ",").alias("removed_lines"),
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_chars`` if there is one set anew.

    No row goes; a text that loses all its lines becomes empty, a null text stays null.
    """
    removed = removed_lines(docs)
    gone, kid = removed["removed"], F.coalesce(docs["doc_id"], F.lit(-(2**63)))
    same = (kid == removed["kid"]) & (F.xxhash64(docs["text"]) == removed["th"])
    # A column of its own, so that a text is split once and not for each line.
    name = spare(docs.columns, "_parts")
    rows = docs.join(removed, same, "left").withColumn(name, F.when(gone.isNotNull(), F.split(docs["text"], "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(name) - 1), gone)
    new = {"text": F.when(gone.isNull(), docs["text"]).otherwise(F.array_join(F.transform(left, lambda i: F.get(name, i)), "\n"))}
    if "n_chars" in docs.columns:
        chars = F.when(gone.isNotNull(), F.length(new["text"])).otherwise(docs["n_chars"])
        new["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, docs[f"`{c}`"]).alias(c) for c in docs.columns])


#: ``line_report`` over documents of different ids, as plain SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(len(parts))) AS n, unnest(parts) AS line FROM d),
u AS MATERIALIZED (SELECT * FROM (
  SELECT doc_id, n, list_sort(list_distinct(regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w FROM l)
  WHERE len(w) > 0),
s AS MATERIALIZED (SELECT w, min({'doc_id': doc_id, 'n': n}) AS f, row_number() OVER () AS id FROM u GROUP BY w),
t AS (SELECT id, unnest(w) AS x FROM s),
o AS (SELECT x, count(*) AS c FROM t GROUP BY x),
r AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY c, x) AS k, count(*) OVER (PARTITION BY id) AS m
      FROM t JOIN o USING (x)),
p AS MATERIALIZED (SELECT id, x, m FROM r WHERE k <= m - (4 * m + 4) // 5 + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id <> b.id
      WHERE 5 * b.m >= 4 * a.m AND 5 * a.m >= 4 * b.m),
j AS (SELECT DISTINCT a.id AS id, true AS matched FROM c JOIN s a ON a.id = c.a JOIN s b ON b.id = c.b
      WHERE b.f < a.f AND 9 * len(list_intersect(a.w, b.w)) >= 4 * (len(a.w) + len(b.w))),
g AS (SELECT u.doc_id, count(*) AS n_removed, string_agg(u.n::VARCHAR, ',' ORDER BY u.n) AS removed_lines
      FROM u JOIN s ON u.w = s.w LEFT JOIN j ON s.id = j.id
      WHERE {'doc_id': u.doc_id, 'n': u.n} <> s.f OR j.matched GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(len(parts), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(removed_lines, '') AS removed_lines
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
