"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

Documents become token ids plus an end mark. Full windows are cut off a long document at once; the rest
(fewer ids than a window) is placed online: with N(h) open windows filled to level h, it goes to the level
that minimises the sum of N(h)^2 after placing, where an empty and a full window count nothing. Ties go to
the fuller window. The array N is all the state that a placement reads.

Every task packs the documents it reads. The windows that are open at its end go to a second round of few
tasks, which places them as wholes by the same rule. What is open after that is joined and cut anew into full
windows, and the last remainder into windows of 2^k ids, which need no padding; so no window is padded at all.
Open windows are bounded: a task of the first round that has ``max_open`` of them hands them all on, one of
the second round cuts them.

Sequence ids hold the round and the task's partition number in the high bits and count inside a task.

Cases: a null text is empty and consists of the end mark alone; repeated rows are packed each; one
document may span many windows, and lies in memory one at a time; an empty table gives an empty result;
other columns are not read.
"""

import os
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quirework.functions.common import materialize
from quirework.llm.text_bytes import BASES, LOWERED, Rolling, bounded, utf8, word_spans

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
TASK_BITS = 40
SECOND = 1 << 22  # partitions of the second round count from here
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 13, 32]] = False
SIGN = np.zeros(256, bool)
SIGN[list(b"!#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
PLAIN = np.zeros(256, bool)
PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
DIVIDERS = "★☆→•"
STORE = "packing_word_store"


def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A store of parts in four arrays: hashes in order, where the ids of each begin, how many they are, all ids."""
    return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")


def _find(store: tuple, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each name in the store, and whether it is there."""
    hashes = store[0]
    if not len(hashes):
        return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(hashes, names), len(hashes) - 1)
    return at, hashes[at] == names


def _joined(store: tuple, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of runs of the store, one run after another."""
    ends = np.cumsum(counts)
    return store[3][np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]


def _with(store: tuple, names: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple:
    """The store with further parts, whose names are in order and new."""
    hashes, starts, lengths, flat = store
    at = np.searchsorted(hashes, names)
    begins = len(flat) + np.cumsum(counts) - counts
    return np.insert(hashes, at, names), np.insert(starts, at, begins), np.insert(lengths, at, counts), np.concatenate((flat, ids))


class WordTokens:
    """Token ids of whole texts from the ids of their words.

    The tokenizer drops white space and no token crosses it, so a text's ids are the ids of its words in
    order. A run of ASCII signs (not the apostrophe) that ends a word and follows an ASCII letter or digit is a
    token sequence of its own, so a word's ids are those of its stem and of that tail; any other word stays
    whole, since signs of all scripts and combining marks join into one sequence. A-Z may be lower-cased
    first. Stems and tails are found and named
    by hashes for many texts together; only distinct ones are looked up, and new ones are encoded, many
    in one call, divided by a sign that is one token. The store of known ones belongs to the worker
    process, not to the task, and lies in a few arrays, since it stays while later stages run; when half full it
    starts anew and takes over what is still asked for.
    """

    def __init__(self, path: str, max_parts: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.max_parts, self.rolling = max_parts, Rolling(BASES[0])
        store = sys.modules.setdefault(STORE, types.ModuleType(STORE)).__dict__  # functions are sent by value, so globals end with the task
        if path not in store:
            store[path] = (Tokenizer.from_file(path), [_nothing(), _nothing()])
        self.tokenizer, self.known = store[path]
        single = [self.tokenizer.encode(sign, add_special_tokens=False).ids for sign in DIVIDERS]
        self.divider, self.divider_id = next(((sign, ids[0]) for sign, ids in zip(DIVIDERS, single) if len(ids) == 1), (None, None))

    def encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as little-endian 32-bit numbers."""
        out: dict[str, bytes] = {}
        together = [p for p in parts if self.divider and self.divider not in p and "<|" not in p]
        chunks = [together[i : i + 256] for i in range(0, len(together), 256)]
        joined = self.tokenizer.encode_batch_fast([f" {self.divider} ".join(c) for c in chunks], add_special_tokens=False)
        for chunk, found in zip(chunks, joined):
            ids = np.array(found.ids, "<u4")
            raw, cuts = ids.tobytes(), (np.flatnonzero(ids == self.divider_id) * 4).tolist()
            for part, a, b in zip(chunk, [-4, *cuts], [*cuts, len(raw)]):
                out[part] = raw[a + 4 : b]
        for part in parts:
            if part not in out:
                out[part] = np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        return [out[p] for p in parts]

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with A-Z lower-cased; starts and ends of stems and tails; each text's first part."""
        low = LOWERED[data]
        starts, ends, _ = word_spans(data, offsets, NOT_BLANK)
        reach = np.maximum.accumulate(np.where(SIGN[low], 0, np.arange(1, len(low) + 1)))
        middle = np.maximum(starts, reach[ends - 1]) if len(ends) else ends
        middle = np.where((middle == starts) | PLAIN[low[middle - 1]], middle, ends)
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        for word in np.unique(np.searchsorted(starts, marks, "right") - 1):  # may hold a special token: kept as it is
            low[starts[word] : ends[word]] = data[starts[word] : ends[word]]
            middle[word] = ends[word]
        first, last = np.column_stack((starts, middle)).ravel(), np.column_stack((middle, ends)).ravel()
        filled = last > first
        first, last = first[filled], last[filled]
        return low, first, last, np.searchsorted(first, offsets)

    def ids(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of the column."""
        data, offsets = utf8(column)
        low, first, last, own = self.parts(data, offsets)
        names, at, which = np.unique(self.rolling.spans(low, first, last), return_index=True, return_inverse=True)
        if len(self.known[0][0]) > self.max_parts // 2:
            self.known[:] = _nothing(), self.known[0]
        known, before = self.known
        unknown = np.flatnonzero(~_find(known, names)[1])
        place, taken = _find(before, names[unknown])
        if taken.any():
            counts = before[2][place[taken]]
            known = _with(known, names[unknown[taken]], counts, _joined(before, before[1][place[taken]], counts))
        missing = unknown[~taken]
        if len(missing):
            words = [low[a:b].tobytes().decode() for a, b in zip(first[at[missing]].tolist(), last[at[missing]].tolist())]
            new = self.encode(words)
            known = _with(known, names[missing], np.array([len(t) // 4 for t in new], np.int64), np.frombuffer(b"".join(new), "<u4"))
        self.known[0] = known
        place, _ = _find(known, names)
        counts = known[2][place][which]
        ends = np.cumsum(counts)
        ids = _joined(known, known[1][place][which], counts)
        cuts = np.r_[0, ends][own].tolist()
        return (ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:]))


Piece = tuple[int, int, bytes, int]  # document, its ids before, ids, ids of the document


class Packer:
    """Windows of one task. ``rows`` collects finished pieces, ``handed`` windows for the second round."""

    def __init__(self, size: int, max_open: int, first_sequence: int, hand_on: bool = False) -> None:
        self.size, self.max_open, self.next, self.hand_on = size, max_open, first_sequence, hand_on
        self.levels = np.zeros(size + 1, np.int64)  # N(h)
        self.open: dict[int, list[list[Piece]]] = {}  # level: windows, each a list of pieces
        self.count = 0
        self.rows: list[tuple] = []
        self.handed: list[list[Piece]] = []

    def close(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc: int, ids: bytes) -> None:
        total, width = len(ids) // 4, 4 * self.size
        whole = total // self.size
        for k in range(whole):
            self.close([(doc, k * self.size, ids[k * width : (k + 1) * width], total)])
        if rest := total - whole * self.size:
            self.place([(doc, whole * self.size, ids[whole * width :], total)], rest)

    def best_level(self, n: int) -> int:
        """The level h at which placing n ids leaves the smallest sum of squares; 0 opens a window."""
        levels, size = self.levels, self.size
        change = 2 * (levels[n:] - levels[: size + 1 - n]) + 2  # N(h) falls by one, N(h + n) rises by one
        change[0] = 2 * levels[n] + 1  # an empty window counts nothing
        change[-1] = 1 - 2 * levels[size - n]  # neither does a full one
        change[1:][levels[1 : size + 1 - n] == 0] = np.iinfo(np.int64).max
        return size - n - int(change[::-1].argmin())

    def place(self, pieces: list[Piece], n: int) -> None:
        """Put pieces of n ids together, fewer than a window, into one window."""
        level = self.best_level(n)
        window = []
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
            self.count -= 1
        window += pieces
        if level + n == self.size:
            self.close(window)
            return
        self.open.setdefault(level + n, []).append(window)
        self.levels[level + n] += 1
        self.count += 1
        if self.count >= self.max_open:
            self.hand() if self.hand_on else self.flush(False)

    def hand(self) -> None:
        """All open windows go to the second round, fullest first."""
        self.handed += [window for level in sorted(self.open, reverse=True) for window in self.open[level]]
        self.open, self.count = {}, 0
        self.levels[:] = 0

    def flush(self, last: bool) -> None:
        """Cut the contents of all open windows anew into full ones, fullest first; the remainder stays open or, at the end, is cut."""
        pieces = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        self.open, self.count = {}, 0
        self.levels[:] = 0
        left = sum(len(p[2]) // 4 for p in pieces)
        window, filled, size = [], 0, self.next_size(left, last)
        for doc, start, ids, total in pieces:
            while ids:
                take = min(len(ids) // 4, size - filled)
                window.append((doc, start, ids[: 4 * take], total))
                start, ids, filled, left = start + take, ids[4 * take :], filled + take, left - take
                if filled == size:
                    self.close(window)
                    window, filled, size = [], 0, self.next_size(left, last)
        if window:
            self.open[filled] = [window]
            self.levels[filled] = self.count = 1

    def next_size(self, left: int, last: bool) -> int:
        return self.size if left >= self.size or not last else 1 << max(0, left.bit_length() - 1)


WINDOW = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]))
FIRST_ROUND = RESULT + ", task long, window array<struct<doc_id:long,start:long,ids:binary,doc_tokens:long>>"


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    end_id: int = 2,
    max_open: int = 4096,
    second_windows: int = 4096,
) -> DataFrame:
    """One row per piece. ``size`` is a power of two; a task of the second round gets about ``second_windows`` windows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = WordTokens(tokenizer_path), struct.pack("<I", end_id)
        task = TaskContext.get().partitionId()
        packer = Packer(size, max_open, task << TASK_BITS, hand_on=True)

        def finished() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows)) or [[]] * len(COLUMNS)
            arrays = [pa.array(c, pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), WINDOW)], [*COLUMNS, "task", "window"])

        def handed() -> Iterator[pa.RecordBatch]:
            windows, packer.handed = packer.handed, []
            for at in range(0, len(windows), 256):
                part = [[dict(zip(("doc_id", "start", "ids", "doc_tokens"), p)) for p in w] for w in windows[at : at + 256]]
                empty = [pa.nulls(len(part), pa.int64())] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([*empty, pa.array([(task << TASK_BITS) + at + k for k in range(len(part))], pa.int64()), pa.array(part, WINDOW)], [*COLUMNS, "task", "window"])

        for batch in bounded(batches, 1):
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1))):
                packer.add(doc, ids + end)
            yield finished()
            yield from handed()
        packer.hand()
        yield from handed()

    def pack_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, max_open, (SECOND + TaskContext.get().partitionId()) << TASK_BITS)

        def finished() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows)) or [[]] * len(COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], COLUMNS)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for window in batch.column(0).slice(at, 64).to_pylist():
                    pieces = [(p["doc_id"], p["start"], p["ids"], p["doc_tokens"]) for p in window]
                    packer.place(pieces, sum(len(p[2]) // 4 for p in pieces))
                yield finished()
        packer.flush(True)
        yield finished()

    first = materialize(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(pack, FIRST_ROUND), "packed")
    open_ = first.where("window IS NOT NULL").select("task", "window")
    tasks = open_.count() // second_windows + 1
    second = open_.repartition(tasks, "task").select("window").mapInArrow(pack_windows, RESULT)
    return first.where("window IS NULL").select(*COLUMNS).union(second)
