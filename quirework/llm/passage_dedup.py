"""Substring deduplication: Rabin-Karp hashes of every window of fixed length in words.

A window is ``width`` consecutive words of one document. Every word that is covered by a window whose
words also start in a document with a smaller id is removed; covered words that overlap or touch form
one maximal interval. Windows are judged on the input, not on what is left.

Round 1 counts the hashes of all windows, each distinct one once per block (see ``blocks``), in 48 bits
beside the bucket's own. Round 2 takes the windows that another block has, too, under a second
independent hash of 64 bits beside the bucket's own, with the smallest id that has it in the block, and
answers with the smallest id overall. Copies inside one block are found by the block itself.

Cases: null text has no words (and the hash of an empty text); texts with fewer words than a window keep
all; null ids count as larger than any other; rows that repeat an id are not smaller than each other; an
empty table gives an empty result; other columns are not read. Words are cut at the six ASCII white-space
characters.
"""

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirework.llm.blocks import Parcels, answer_table, bits, bucket_of, from_blocks, in_blocks, mark_shared, received, spread, with_answers
from quirework.llm.text_bytes import BASES, NOT_SPACE, Rolling, utf8, word_spans

RESULT = "doc_id long, n_words long, n_removed long, n_spans long, text string"
LARGEST = np.iinfo(np.int64).max


class Windows:
    """Distinct windows of a block and where they stand."""

    def __init__(self, rows: pa.Table, width: int, second: bool) -> None:
        self.docs = rows.column("doc_id").fill_null(LARGEST).to_numpy()
        self.data, self.offsets = utf8(rows.column("text"))
        starts, ends, self.first = word_spans(self.data, self.offsets, NOT_SPACE)
        hashes = [Rolling(base) for base in (BASES if second else BASES[:1])]
        words = hashes[0].spans(self.data, starts, ends)
        per_doc = np.maximum(np.diff(self.first) - width + 1, 0)
        self.owner = np.repeat(np.arange(len(per_doc)), per_doc)
        within = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        self.at = np.repeat(self.first[:-1], per_doc) + within  # first word of each window
        found = [h.windows(words, width)[self.at] for h in hashes]
        self.names, self.which = np.unique(found[0], return_inverse=True)
        self.smallest = np.full(len(self.names), LARGEST)
        np.minimum.at(self.smallest, self.which, self.docs[self.owner])
        if second:
            self.second = np.zeros(len(self.names), np.uint64)
            self.second[self.which] = found[1]

    def parcels(self, buckets: int) -> Parcels:
        return Parcels(bucket_of(self.names, buckets))


def dedup_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 50,
    block_bytes: int = 4 << 20,
    bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """``doc_id, n_words, n_removed, n_spans, text`` per row; ``text`` is the kept words joined by one space."""
    blocks, buckets = in_blocks(docs, id_col, text_col, block_bytes, bucket_bytes)

    def send_all(block: int, rows: pa.Table) -> pa.Table:
        windows = Windows(rows, width, False)
        return windows.parcels(buckets).send(block, (windows.names, 6))

    def shared_windows(windows: Windows, answers: pa.Table) -> tuple[np.ndarray, Parcels]:
        shared = np.flatnonzero(windows.parcels(buckets).marked(answers, 1, len(windows.names)))
        return shared, Parcels(bucket_of(windows.names[shared], buckets))

    def send_shared(block: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        windows = Windows(rows, width, True)
        shared, parcels = shared_windows(windows, answers)
        return parcels.send(block, (windows.second[shared], 8), (windows.smallest[shared].view(np.uint64), 8))

    def smallest_ids(key: tuple, table: pa.Table) -> pa.Table:
        names, counts, (keys, docs) = received(table, [8, 8])
        docs = docs.view(np.int64)
        order = np.lexsort((docs, keys))
        opens = np.r_[True, keys[order][1:] != keys[order][:-1]]
        least = np.empty(len(keys), np.int64)
        least[order] = docs[order][np.flatnonzero(opens)][np.cumsum(opens) - 1]
        payloads, cuts = [], np.r_[0, np.cumsum(counts)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            lower = least[a:b] < docs[a:b]
            ids = least[a:b][lower].view(np.uint8).reshape(-1, 8).T.tobytes()
            payloads.append(np.packbits(lower).tobytes() + ids if lower.any() else None)
        return answer_table(names, 2, key[0].as_py(), payloads)

    def remove(block: int, rows: pa.Table, answers: pa.Table) -> pa.Table:
        windows = Windows(rows, width, True)
        shared, parcels = shared_windows(windows, answers)
        smallest = windows.smallest
        for places, payload in parcels.answered(answers, 2):
            head = -(-len(places) // 8)
            lower = bits(payload[:head], len(places))
            ids = np.ascontiguousarray(np.frombuffer(payload[head:], np.uint8).reshape(8, -1).T).view("<i8").ravel()
            smallest[shared[places[lower]]] = ids
        gone = smallest[windows.which] < windows.docs[windows.owner]
        edges = np.zeros(int(windows.first[-1]) + 1, np.int32)
        np.add.at(edges, windows.at[gone], 1)
        np.add.at(edges, windows.at[gone] + width, -1)
        keep = np.cumsum(edges[:-1]) == 0
        removed_before = np.r_[0, np.cumsum(~keep)]
        texts, spans = [], []
        for i, (a, b) in enumerate(zip(windows.first[:-1].tolist(), windows.first[1:].tolist())):
            words = windows.data[windows.offsets[i] : windows.offsets[i + 1]].tobytes().split()
            own = keep[a:b]
            if removed_before[b] > removed_before[a]:
                words = compress(words, own)
                spans.append(int((~own & np.r_[True, own[:-1]]).sum()))
            else:
                spans.append(0)
            texts.append(b" ".join(words))
        removed = removed_before[windows.first[1:]] - removed_before[windows.first[:-1]]
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n_words": pa.array(np.diff(windows.first)),
                "n_removed": pa.array(removed),
                "n_spans": pa.array(spans, pa.int64()),
                "text": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    marks = mark_shared(from_blocks(blocks, send_all), 1, 6, buckets)
    sent = with_answers(blocks, marks, send_shared, "bucket int, block int, payload binary")
    least = spread(sent, "bucket", buckets).groupBy("bucket").applyInArrow(smallest_ids, "block int, round int, bucket int, payload binary")
    return with_answers(blocks, marks.union(least), remove, RESULT)
