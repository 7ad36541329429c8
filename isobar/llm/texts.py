"""Words of many texts at once, as numpy arrays over an Arrow column's own bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are taken together; a longer text is taken alone.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}
_MIX = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Space, tab, line feed, vertical tab, form feed and carriage return end a word.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(
    np.uint8
)


def release() -> None:
    """Give memory that is free in this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc's own; other libraries do without
        trim(0)


def releasing(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``each`` for ``mapInArrow`` whose worker does not keep a task's memory for the next ones.

    Workers live on from stage to stage, and their tables, freed with the task, else
    add up beside those of the stages that follow.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(batches)
        finally:
            release()

    return task


def spare(columns: Iterable[str], name: str = "_text") -> str:
    """A column name that is not among ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


class Words:
    """Words of some texts: byte ranges, the text each is in, and 64-bit hashes.

    ``member`` tells for each byte whether it belongs to a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        self.data, self.offsets = data, offsets
        before, after = np.zeros_like(member), np.zeros_like(member)
        before[1:], after[:-1] = member[:-1], member[1:]
        filled = offsets[1:] > offsets[:-1]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(member & ~before)
        self.ends = np.flatnonzero(member & ~after) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.bincount(self.text, minlength=len(self.offsets) - 1)

    def hashes(self, folded: np.ndarray) -> np.ndarray:
        """Hash of each word, of the bytes in ``folded`` (same places as the text's)."""
        return range_hashes(folded, self.starts, self.ends)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIX[data] * _power("up", _BASE, len(data)), out=sums[1:])
    down = _power("down", _INVERSE, len(data) + 1)
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sums_by_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are flagged."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        step = np.full(n, base, np.uint64)
        step[0] = 1
        _powers[name] = np.cumprod(step, dtype=np.uint64)
    found = _powers[name][:n]
    if n > 8 * CHUNK:  # one very long text: its table is not kept
        _powers[name] = found[:CHUNK].copy()
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_of(word: str) -> int:
    """The hash that a word of these characters has in a text."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(range_hashes(data, np.array([0]), np.array([len(data)]))[0])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbours, wherever texts begin and end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + hashes[i : i + n]
    return mixed(total)
