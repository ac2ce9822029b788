"""Exchange of window hashes between blocks of documents.

Documents are dealt by a hash of id and text into blocks of bounded size. A block names each of its windows
by a hash and sends every distinct one once, packed into one binary value per bucket of hash values. A
bucket compares what the blocks sent and answers every block with one bit per hash it sent. Blocks and
buckets, and the partitions they lie in, grow in number with the input and not in size; a window that a third of all documents share is
sent once per block, so no bucket gathers the documents that share it.

A block computes the same hashes in the same order each time, so answers need no keys. All rounds read
the documents from one and the same exchange.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SENT = "bucket int, block int, payload binary"
ANSWER = "block int, round int, bucket int, payload binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
ANSWER_SCHEMA = pa.schema([("block", pa.int32()), ("round", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])

Work = Callable[[int, pa.Table], pa.Table]


def in_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """``block, doc_id, text`` with as many blocks as the texts fill, and a number of buckets to go with it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = total // block_bytes + 1
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    return spread(dealt, "block", blocks), total // bucket_bytes + 1


def spread(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows by a key of n values, in partitions of their own where they are more than the session's."""
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key) if n > own else rows


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Parcels:
    """The order in which a block sends its hashes: by bucket, otherwise as given."""

    def __init__(self, bucket: np.ndarray) -> None:
        self.order = np.argsort(bucket, kind="stable")
        ordered = bucket[self.order]
        self.first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        self.last = np.r_[self.first[1:], len(ordered)] if len(ordered) else self.first
        self.names = ordered[self.first].tolist() if len(ordered) else []

    def send(self, block: int, *fields: tuple[np.ndarray, int]) -> pa.Table:
        """One row per bucket: its count of hashes (4 bytes), then each field's low bytes, byte position by byte position."""
        payloads = []
        columns = [(f[self.order].astype("<u8").view(np.uint8).reshape(-1, 8), width) for f, width in fields]
        for a, b in zip(self.first.tolist(), self.last.tolist()):
            parts = [np.uint32(b - a).tobytes()] + [c[a:b, :width].T.tobytes() for c, width in columns]
            payloads.append(b"".join(parts))
        return pa.Table.from_arrays(
            [pa.array(self.names, pa.int32()), pa.array([block] * len(self.names), pa.int32()), pa.array(payloads, pa.binary())], schema=SENT_SCHEMA
        )

    def answered(self, answers: pa.Table, which: int) -> list[tuple[np.ndarray, bytes]]:
        """Per answering bucket: the places (in the given order) of its hashes, and the payload."""
        at = dict(zip(self.names, zip(self.first.tolist(), self.last.tolist())))
        out = []
        for number, bucket, payload in zip(*(answers.column(c).to_pylist() for c in ("round", "bucket", "payload"))):
            if number == which:
                a, b = at[bucket]
                out.append((self.order[a:b], payload))
        return out

    def marked(self, answers: pa.Table, which: int, n: int) -> np.ndarray:
        out = np.zeros(n, bool)
        for places, payload in self.answered(answers, which):
            out[places] = bits(payload, len(places))
        return out


def bits(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)


def received(table: pa.Table, widths: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Blocks of the rows, the rows' counts, and the fields of all rows joined."""
    payloads = [np.frombuffer(p, np.uint8) for p in table.column("payload").to_pylist()]
    counts = np.array([int(p[:4].view(np.uint32)[0]) for p in payloads], np.int64)
    fields, skip = [], 4
    for k, width in enumerate(widths):
        out = np.zeros((int(counts.sum()), 8), np.uint8)
        at = 0
        for p, n in zip(payloads, counts.tolist()):
            start = 4 + sum(widths[:k]) * n
            out[at : at + n, :width] = p[start : start + width * n].reshape(width, n).T
            at += n
        fields.append(out.view("<u8").ravel())
    return table.column("block").to_numpy(), counts, fields


def answer_table(blocks: np.ndarray, which: int, bucket: int, payloads: list[bytes | None]) -> pa.Table:
    rows = [(int(b), p) for b, p in zip(blocks, payloads) if p is not None]
    return pa.Table.from_arrays(
        [
            pa.array([b for b, _ in rows], pa.int32()),
            pa.array([which] * len(rows), pa.int32()),
            pa.array([bucket] * len(rows), pa.int32()),
            pa.array([p for _, p in rows], pa.binary()),
        ],
        schema=ANSWER_SCHEMA,
    )


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    np.equal(s[1:], s[:-1], out=same[1:-1]) if len(s) else None
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def mark_shared(sent: DataFrame, which: int, width: int, buckets: int) -> DataFrame:
    """Answers with one bit per hash: does another block send it, too? Blocks without any get no answer."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        blocks, counts, (keys,) = received(table, [width])
        shared = repeated(keys)
        cuts = np.r_[0, np.cumsum(counts)]
        parts = [shared[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return answer_table(blocks, which, key[0].as_py(), [np.packbits(p).tobytes() if p.any() else None for p in parts])

    return spread(sent, "bucket", buckets).groupBy("bucket").applyInArrow(compare, ANSWER)


def from_blocks(blocks: DataFrame, work: Work) -> DataFrame:
    """What each block sends: ``work(block, rows)``."""
    return blocks.groupBy("block").applyInArrow(lambda key, table: work(key[0].as_py(), table), SENT)


def with_answers(blocks: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work(block, rows, answers)`` for each block."""
    return (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(lambda key, rows, found: work(key[0].as_py(), rows, found), schema)
    )
