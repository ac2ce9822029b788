"""Numpy helpers over the UTF-8 bytes of an Arrow string column: words, polynomial hashes, windows."""

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 1 << 18  # values hashed at a time, which bounds the tables of powers
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, hence invertible modulo 2^64

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACES
LOWERED = np.arange(256, dtype=np.uint8)  # A-Z to a-z
LOWERED[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after another, and the offsets of the values (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounded(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most ``max_bytes`` of text, or of one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        reach, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            before = reach[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(reach, before + max_bytes, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    release_memory()


def release_memory() -> None:
    """Give freed memory back: a worker process outlives its tasks, and others run beside it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each value, and each value's first word."""
    inside = is_word[data]
    lengths = np.diff(offsets)
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[offsets[:-1][lengths > 0]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][lengths > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base modulo 2^64, and of its inverse."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


NEAR = 64  # places inside a span whose numbers are tabled


class Rolling:
    """Hashes of byte spans and Rabin-Karp hashes of windows of numbers.

    A span sums one number per byte and place, drawn from both by a bijection, so spans that differ are
    told apart whatever they repeat; a polynomial modulo 2^64 gives some strings of 1,024 bytes one value
    under every odd base. A window is the sum of value[i + k] * base^k, by differences of running sums.
    """

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, *powers(base, STEP)
        self.near = mix((np.arange(256 * NEAR, dtype=np.uint64) + np.uint64(1)) * np.uint64(base))
        self.byte = self.near[:256]

    def numbers(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The number of each byte at its place inside its span."""
        at = (places << 8) + data
        if len(at) and int(places.max()) >= NEAR:
            return mix((at.astype(np.uint64) + np.uint64(1)) * np.uint64(self.base))
        return self.near[at]

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return (self.up, self.down) if n <= STEP else powers(self.base, n)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte span; spans are in order, don't overlap and hold a byte at least."""
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
            lengths = ends[i:j] - starts[i:j]
            first = np.cumsum(lengths) - lengths
            places = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            out[i:j] = np.add.reduceat(self.numbers(data[places + np.repeat(starts[i:j], lengths)], places), first)
            i = j
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(BASES[0]))

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash of every ``width`` consecutive values: ``len(values) - width + 1`` of them."""
        total = max(0, len(values) - width + 1)
        out, step = np.empty(total, np.uint64), max(STEP - width, 1)
        up, down = self.tables(min(step, total) + width)
        for at in range(0, total, step):
            part = values[at : at + step + width - 1]
            n = len(part) - width + 1
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            out[at : at + n] = (sums[width:] - sums[:-width]) * down[:n]
        return mix(out)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch; starts are in order."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    opens = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[opens], np.r_[reach[opens[1:] - 1], reach[-1]]
