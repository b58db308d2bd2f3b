"""Words and word hashes of many texts at once, over the bytes of Arrow string arrays.

A word is a run of bytes other than space and 0x09-0x0D. Texts are handled in chunks of bounded size, a longer
text being a chunk of its own. Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SLICE_ROWS = 1024  # of a batch that are copied at a time
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two hash families


#: The module-like place where an operator keeps things in a Python worker from task to task.
WORKER_MEMORY = "_corpus_worker_memory"


Batches = Iterator[pa.RecordBatch]


def hand_back() -> None:
    """Give freed memory to the system: Arrow and the C library keep it unless they are told."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def release_worker_memory() -> None:
    """Drop what operators keep in this Python worker; workers pass from one operator to the next."""
    if sys.modules.pop(WORKER_MEMORY, None) is not None:
        gc.collect()
        hand_back()


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The function of a task, which drops what other operators kept and leaves no freed memory to an idle worker."""

    @wraps(run)
    def whole(batches: Batches) -> Batches:
        release_worker_memory()
        yield from run(batches)
        hand_back()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _bytes_table(family: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE[family]))


@dataclass
class Chunk:
    """Texts ``first`` to ``last`` of a batch: their bytes, and where each begins and ends in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Consecutive texts of at most ``limit`` bytes together, or one longer text; null counts as empty."""
    for first in range(0, len(texts), SLICE_ROWS):
        whole = pc.fill_null(texts.slice(first, SLICE_ROWS), "").cast(pa.large_string())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(whole):
            last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            own = data[offsets[at] : offsets[last]]
            yield Chunk(first + at, first + last, own, offsets[at : last + 1] - offsets[at])
            at = last


@dataclass
class Words:
    """Words of a chunk in order: bytes ``start`` to ``end``, and the text each belongs to."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    #: Number of the first word of each text, and the number of all words.
    bounds: np.ndarray


def words_of(chunk: Chunk) -> Words:
    n = len(chunk.data)
    inside = ~_SPACE[chunk.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    bounds = np.searchsorted(start, chunk.offsets)
    text = np.repeat(np.arange(len(chunk.offsets) - 1), np.diff(bounds))
    return Words(start, np.flatnonzero(ends) + 1, text, bounds)


class WordHasher:
    """64-bit hashes of words, byte ranges in order, by prefix sums of a polynomial with a random value per byte.

    Sums take some 40 bytes per byte, so they cover ``CHUNK_BYTES`` at a time, or one longer word.
    """

    def __init__(self, family: int = 0, lower: bool = False):
        table = _bytes_table(family)
        self.table = table[LOWER] if lower else table
        self.base = np.uint64(_BASE[family])
        self.inverse = np.uint64(pow(_BASE[family], -1, 2**64))
        self.power = self.unpower = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, CHUNK_BYTES + 1)
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.base)]), dtype=np.uint64)
            self.unpower = np.cumprod(
                np.concatenate([[np.uint64(1)], np.full(size - 1, self.inverse)]), dtype=np.uint64
            )

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            last = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, "right")))
            first = start[at]
            out[at:last] = self._hashes(data[first : end[last - 1]], start[at:last] - first, end[at:last] - first)
            at = last
        return out

    def _hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:n], out=sums[1:])
        value = (sums[end] - sums[start]) * self.unpower[start]
        return mix(value + (end - start).astype(np.uint64) * self.base)


def windows(hashes: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values; the caller drops runs that leave a text."""
    n = max(0, len(hashes) - size + 1)
    value = np.zeros(n, np.uint64)
    for j in range(size):
        value *= np.uint64(_BASE[1 - family])
        value += hashes[j : j + n]
    return mix(value)


def within(text: np.ndarray, size: int) -> np.ndarray:
    """Whether the run of ``size`` words from each word stays in one text."""
    n = max(0, len(text) - size + 1)
    return text[:n] == text[size - 1 : size - 1 + n]
