"""Suffix-array deduplication of byte strings by bucket-pointer refinement.

Suffixes matter only up to ``depth`` = 200 bytes: two of them that agree so far are a repeated string.
Every offset starts in the bucket of its first 25 bytes. A bucket is refined by the identifiers of the
buckets at later offsets: the bucket at depth 50 is named by the bucket at depth 25 of the offset and of
the offset 25 further on, depth 100 by two of depth 50, depth 200 by two of depth 100, so each refined
name is reused for all offsets. Names are hashes, so that all tasks give the same name to a bucket
without ranking all suffixes together; sorting the names puts the suffixes of a bucket side by side.

A bucket with one suffix needs no more refinement. To find those without sending every suffix, a block
sends buckets of depth 100 only where the name is the smallest of the 101 offsets that a 200-byte string
holds (leftmost of equals). Equal strings have their smallest name at the same place; a string whose
sampled bucket occurs nowhere else cannot repeat. The suffixes that remain are refined to depth 200 and
sent to the bucket tasks, which sort them and answer which ones another block has as well (64 bits
beside the bucket's own). Repeats inside one block are found by the block itself.

Each byte covered by a repeated string is removed, same document included; strings are judged on the
input. Cases: null text is empty; texts shorter than ``depth`` keep all; cuts may fall inside a UTF-8
character, so the kept bytes are binary; repeated rows are repeats of each other; an empty table gives
an empty result; other columns are not read; a text of any length is handled whole by one task.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirework.llm.blocks import SENT, Parcels, bucket_of, from_blocks, in_blocks, mark_shared, repeated, with_answers
from quirework.llm.text_bytes import BASES, Rolling, mix, utf8

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
CHUNK = 1 << 16  # offsets handled at a time, so that work stays in the processor's cache
PLACE = np.uint64(18)  # low bits of a name that give way to the offset within a chunk
FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def refine(names: np.ndarray, step: int) -> np.ndarray:
    """Names at depth 2 * ``step`` from those at ``step``."""
    out = names[:-step] * FACTOR
    out += names[step:]
    out ^= out >> np.uint64(29)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, reach = values, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - reach :]) if width > reach else out


class Suffixes:
    """Offsets of a block that start a string of ``depth`` bytes, their names and sampled offsets."""

    def __init__(self, rows: pa.Table, depth: int) -> None:
        self.data, self.offsets = utf8(rows.column("text"))
        half = depth // 2
        size, n = len(self.data), max(len(self.data) - depth + 1, 0)
        long = np.diff(self.offsets) >= depth
        starts, stops = self.offsets[:-1][long], self.offsets[1:][long] - depth + 1
        inside = np.zeros(size + 1, bool)
        for a, b in zip(starts.tolist(), stops.tolist()):
            inside[a:b] = True
        self.inside = inside[:n]
        self.halves = np.empty(n + half, np.uint64) if n else np.zeros(0, np.uint64)
        self.names = np.empty(n, np.uint64)
        self.sampled = np.empty(n, np.int64)
        rolling, quarter = Rolling(BASES[0]), depth // 8
        for at in range(0, n, CHUNK):
            stop = min(at + CHUNK, n)
            values = rolling.byte[self.data[at : stop + depth - 1]]
            names = rolling.windows(values, quarter)
            names = refine(refine(names, quarter), 2 * quarter)  # depth / 2
            self.halves[at : stop + half] = names[: stop + half - at]
            place = np.arange(len(names), dtype=np.uint64)
            low = sliding_min((names >> PLACE << PLACE) | place, half + 1)
            self.sampled[at:stop] = (low & np.uint64((1 << 18) - 1)).astype(np.int64) + at
            self.names[at:stop] = refine(names, half)


class Samples:
    """Distinct sampled buckets of a block."""

    def __init__(self, suffixes: Suffixes) -> None:
        chosen = np.zeros(len(suffixes.halves), bool)
        chosen[suffixes.sampled[suffixes.inside]] = True
        self.places = np.flatnonzero(chosen)
        self.names, self.which, self.count = np.unique(mix(suffixes.halves[self.places]), return_inverse=True, return_counts=True)

    def parcels(self, buckets: int) -> Parcels:
        return Parcels(bucket_of(self.names, buckets))

    def open_offsets(self, suffixes: Suffixes, shared: np.ndarray) -> np.ndarray:
        """Offsets whose sampled bucket holds something else; ``shared`` is per distinct bucket."""
        alive = np.zeros(len(suffixes.halves), bool)
        alive[self.places[shared[self.which]]] = True
        return np.flatnonzero(suffixes.inside & alive[suffixes.sampled])


def refined(suffixes: Suffixes, at: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names at full depth of the given offsets."""
    head, tail = suffixes.halves[at], suffixes.halves[at + half]
    return mix(suffixes.names[at]), mix(mix(head) + tail * FACTOR)


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = 200,
    block_bytes: int = 3 << 20,
    bucket_bytes: int = 24 << 20,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` per row. ``depth`` is a multiple of 8."""
    blocks, buckets = in_blocks(docs, id_col, text_col, block_bytes, bucket_bytes)
    half = depth // 2

    def send_samples(block: int, rows: pa.Table) -> pa.Table:
        samples = Samples(Suffixes(rows, depth))
        return samples.parcels(buckets).send(block, (samples.names, 6))

    def open_elsewhere(suffixes: Suffixes, samples: Samples, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, Parcels, np.ndarray]:
        """Distinct refined names of offsets whose sampled bucket another block has: first places, names, order of sending."""
        shared = samples.parcels(buckets).marked(answers, 1, len(samples.names))
        at = samples.open_offsets(suffixes, shared)
        first, second = refined(suffixes, at, half)
        names, which, back = np.unique(second, return_index=True, return_inverse=True)
        return at, names, Parcels(bucket_of(first[which], buckets)), back

    def send_open(block: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        suffixes = Suffixes(rows, depth)
        _, names, parcels, _ = open_elsewhere(suffixes, Samples(suffixes), answers)
        return parcels.send(block, (names, 8))

    def remove(block: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        suffixes = Suffixes(rows, depth)
        samples = Samples(suffixes)
        at, names, parcels, back = open_elsewhere(suffixes, samples, answers)
        found = at[parcels.marked(answers, 2, len(names))[back]]
        own = samples.open_offsets(suffixes, samples.count > 1)
        own = own[repeated(refined(suffixes, own, half)[1])]
        size = len(suffixes.data)
        starts = np.zeros(size + 1, bool)
        starts[found] = starts[own] = True
        places = np.flatnonzero(starts)
        gone = np.zeros(size + 1, bool)
        if len(places):
            opens = np.flatnonzero(np.r_[True, np.diff(places) > depth])  # runs that neither overlap nor touch
            edges = np.zeros(size + 1, np.int8)
            edges[places[opens]] += 1
            edges[np.r_[places[opens[1:] - 1], places[-1]] + depth] -= 1
            gone = np.cumsum(edges, dtype=np.int8).astype(bool)
        counts, spans, kept = [], [], []
        for a, b in zip(suffixes.offsets[:-1].tolist(), suffixes.offsets[1:].tolist()):
            own_gone = gone[a:b]
            n = int(own_gone.sum())
            counts.append(n)
            spans.append(int(np.count_nonzero(own_gone[1:] & ~own_gone[:-1]) + own_gone[0]) if n else 0)
            kept.append((suffixes.data[a:b][~own_gone] if n else suffixes.data[a:b]).tobytes())
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n_bytes": pa.array(np.diff(suffixes.offsets)),
                "n_removed": pa.array(counts, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    marks = mark_shared(from_blocks(blocks, send_samples), 1, 6, buckets)
    again = mark_shared(with_answers(blocks, marks, send_open, SENT), 2, 8, buckets)
    return with_answers(blocks, marks.union(again), remove, RESULT)
