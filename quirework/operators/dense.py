"""Exact dense retrieval: matrix products next to the chunk rows, a running top k per task, then a merge."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quirework.functions.common import fits_broadcast, materialize
from quirework.operators.lexical import top_k

QUERY_BLOCK = 4_096
CHUNK_BLOCK = 65_536
# One product in a task holds at most this many scores on each side.
QUERY_SLICE = 512
CHUNK_SLICE = 4_096
# A group of questions is held by a task while chunks stream past it, in at most so many rows and bytes; groups
# are no more than FEW_GROUPS, and parts of the chunks no more than one, as long as this bound and PART allow it.
GROUP_ROWS = 32_768
GROUP_BYTES = 64 * 1024 * 1024
FEW_GROUPS = 24
PART = 262_144


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.full_like(vectors, np.nan), where=norms > 0)


def _best(asked: np.ndarray, stored: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question row, chunk row, score) of each question's best k chunks in a slice.

    ``stored`` is in id order, so among equal scores the smallest ids are taken and a
    passage stored a million times still yields k rows.
    """
    scores = np.round(asked @ stored.T, digits)
    scores[np.isnan(scores)] = -np.inf
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above, level = scores > floor, scores == floor
        room = k - above.sum(axis=1, keepdims=True)
        taken = above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= room))
    else:
        taken = np.ones(scores.shape, dtype=bool)
    q, c = np.nonzero(taken & (scores > -np.inf))
    return q, c, scores[q, c]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _keep_best(found: pa.Table, k: int) -> pa.Table:
    """The best k rows of every question (column ``q``), ties by chunk id."""
    found = found.sort_by([("q", "ascending"), ("score", "descending"), ("chunk_id", "ascending")])
    q = found.column("q").to_numpy()
    return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


class _Running:
    """The best k chunks of every question so far, fed with batches of chunks.

    Single-precision products only rule out chunks that stand clearly below a question's k-th best score;
    those they leave are scored in double precision. Memory follows from the questions, k and the slices.
    """

    def __init__(self, asked: np.ndarray, k: int, digits: int):
        self.asked, self.k, self.digits = asked, k, digits
        self.rough = asked.astype(np.float32)
        self.margin = (asked.shape[1] + 4) * 6e-8 + 10.0**-digits  # error of a rough score, and of rounding
        self.floor = np.full(len(asked), -np.inf)  # a k-th best score
        self.found: list[pa.Table] = []
        self.waiting = 0
        self.last = None  # the largest chunk id so far

    def add(self, ids: pa.Array, embeddings: pa.Array) -> None:
        for at in range(0, len(ids), CHUNK_SLICE):
            order = pc.sort_indices(ids.slice(at, CHUNK_SLICE))
            self._add(ids.slice(at, CHUNK_SLICE).take(order), _unit(_matrix(embeddings.slice(at, CHUNK_SLICE).take(order))))

    def _add(self, ids: pa.Array, stored: np.ndarray) -> None:
        first, last = ids[0].as_py(), ids[-1].as_py()
        later = self.last is None or first > self.last  # an equal score comes too late then
        self.last = last if later else max(self.last, last)
        rough = np.ascontiguousarray(stored.T, dtype=np.float32)
        for start in range(0, len(self.asked), QUERY_SLICE):
            asked, floor = self.asked[start : start + QUERY_SLICE], self.floor[start : start + QUERY_SLICE]
            near = self.rough[start : start + QUERY_SLICE] @ rough >= (floor - self.margin).astype(np.float32)[:, None]
            if np.count_nonzero(near) * 2 * asked.shape[1] > near.size:
                q, c, score = _best(asked, stored, self.k, self.digits)
            else:
                q, c = np.nonzero(near)
                score = np.round(np.einsum("ij,ij->i", asked[q], stored[c]), self.digits)
            kept = score > floor[q] if later else score >= floor[q]
            q, c, score = q[kept], c[kept], score[kept]
            if len(q):
                self.found.append(pa.table({"q": pa.array(q + start), "chunk_id": ids.take(pa.array(c)), "score": pa.array(score)}))
                self.waiting += len(q)
        if self.waiting > self.k * len(self.asked):
            self._cut()

    def _cut(self) -> None:
        best = _keep_best(pa.concat_tables(self.found), self.k).combine_chunks()
        self.found, self.waiting = [best], 0
        counts = np.bincount(best.column("q").to_numpy(), minlength=len(self.asked))
        full = counts == self.k
        self.floor[full] = best.column("score").to_numpy()[np.cumsum(counts)[full] - 1]

    def hits(self, question_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.found:
            self._cut()
            best = self.found[0]
            named = question_ids.take(best.column("q").combine_chunks())
            columns = [named, best.column("chunk_id"), best.column("score")]
            yield from pa.table(columns, ["question_id", "chunk_id", "score"]).to_batches(max_chunksize=10_000)


def dense_topk(
    questions: DataFrame, chunks: DataFrame, k: int, digits: int = 6, query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK
) -> DataFrame:
    """(question_id, chunk_id, score, rank) by cosine similarity rounded to ``digits``.

    Question vectors within the broadcast bound are shipped once and the chunk table is
    only scanned: a task keeps a running top k per question and yields it once, at its end,
    and a small shuffle merges the tasks. Larger question sets are dealt into groups that
    chunks stream past (``grouped``); both are exact.
    """
    asked = questions.select("question_id", "embedding").filter(F.col("embedding").isNotNull())
    stored = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    types = dict(asked.dtypes) | dict(stored.dtypes)
    schema = f"question_id {types['question_id']}, chunk_id {types['chunk_id']}, score double"
    if not fits_broadcast(asked, max_rows=query_block):
        one = F.lit(0).alias("cell")
        return top_k(grouped(asked.select("*", one), stored.select("*", one), k, digits, query_block, chunk_block), k)

    table = asked.toArrow()
    if table.num_rows == 0:
        return top_k(asked.sparkSession.createDataFrame([], schema), k)
    shared = asked.sparkSession.sparkContext.broadcast(
        (table.column("question_id").combine_chunks(), _unit(_matrix(table.column("embedding"))))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        best = _Running(vectors, k, digits)
        for batch in batches:
            best.add(batch.column("chunk_id"), batch.column("embedding"))
        yield from best.hits(ids)

    return top_k(stored.mapInArrow(score, schema), k)


def _at_most(rows: Column, block: int, few: int, rows_each: Column) -> Column:
    """Into how many blocks rows are dealt: none smaller than ``block`` is made, and beyond ``few`` only as ``rows_each`` wants it."""
    return F.least(F.ceil(rows / block), F.greatest(F.lit(few), F.ceil(rows / rows_each))).cast("int")


def grouped(asking: DataFrame, held: DataFrame, k: int, digits: int, query_block: int, chunk_block: int) -> DataFrame:
    """(question_id, chunk_id, score): the best k of each question in every ``cell``, some of them once per part of the chunks.

    Per cell questions are dealt into groups and chunks into parts. A task holds the questions of one group
    while the chunks of one part stream past, so its memory depends on neither table's size; a row is copied as
    often as there are groups or parts on the other side, whose number the smallest blocks don't drive.
    """
    types = dict(asking.dtypes) | dict(held.dtypes)
    schema = f"question_id {types['question_id']}, chunk_id {types['chunk_id']}, score double"
    rows = F.count("*")
    each = F.greatest(F.lit(1), F.least(F.lit(GROUP_ROWS), F.floor(GROUP_BYTES / F.greatest(F.lit(1), 12 * F.max(F.size("embedding"))))))
    asked_sizes = asking.groupBy("cell").agg(_at_most(rows, query_block, FEW_GROUPS, each).alias("n_q"))
    held_sizes = held.groupBy("cell").agg(_at_most(rows, chunk_block, 1, F.lit(PART)).alias("n_c"))
    sizes = materialize(asked_sizes.join(held_sizes, "cell"), "cell-sizes")  # a row per cell
    products = int(sizes.agg(F.coalesce(F.sum(F.col("n_q") * F.col("n_c")), F.lit(1))).first()[0])

    of = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    product = (F.col("cell") * (1 << 40) + F.col("group") * (1 << 20) + F.col("part")).alias("product")
    no = lambda name: F.lit(None).cast(types[name]).alias(name)
    left = asking.join(F.broadcast(sizes), "cell").select("*", of("question_id", "n_q").alias("group"), every("n_c").alias("part"))
    right = held.join(F.broadcast(sizes), "cell").select("*", of("chunk_id", "n_c").alias("part"), every("n_q").alias("group"))
    both = left.select(product, F.lit(0).alias("side"), "question_id", no("chunk_id"), "embedding").unionByName(
        right.select(product, F.lit(1).alias("side"), no("question_id"), "chunk_id", "embedding")
    )
    # products that meet in one partition follow one another; more partitions than products make that rare
    placed = both.repartition(4 * products, "product").sortWithinPartitions("product", "side", "chunk_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, asked, ids, best = None, [], None, None
        for batch in batches:
            keys = batch.column("product").to_numpy() * 2 + batch.column("side").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)] if len(keys) else []
            for start, end in zip(starts, starts[1:]):
                run, key = batch.slice(start, end - start), int(keys[start])
                if key >> 1 != current:
                    if best is not None:
                        yield from best.hits(ids)
                    current, asked, best = key >> 1, [], None
                if key & 1 == 0:
                    asked.append((run.column("question_id"), _unit(_matrix(run.column("embedding")))))
                elif asked or best is not None:
                    if best is None:
                        ids = pa.concat_arrays([i for i, _ in asked])
                        best, asked = _Running(np.concatenate([v for _, v in asked]), k, digits), []
                    best.add(run.column("chunk_id"), run.column("embedding"))
        if best is not None:
            yield from best.hits(ids)

    return placed.mapInArrow(work, schema)
