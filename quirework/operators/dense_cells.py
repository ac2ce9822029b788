"""Approximate dense retrieval: chunks stand in cells around centroids, a question looks into the nearest cells only.

A named mode beside the exact ``dense_topk``: hits are scored exactly, but a chunk in a cell that is not
looked into is missed. ``recall`` measures what that costs, and ``probes_for`` finds the number of cells
that a wanted recall takes. Centroids are fitted on a sample of bounded size; every chunk is indexed.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirework.functions.common import materialize
from quirework.operators.dense import CHUNK_BLOCK, QUERY_BLOCK, _matrix, _unit, dense_topk, grouped
from quirework.operators.lexical import top_k

SAMPLE = 20_000
MOST_CELLS = 4_096


def fit_centroids(chunks: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centroids of at most ``sample`` chunks, those with the smallest hashes of their ids, by spherical k-means."""
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"between 1 and {MOST_CELLS} cells")
    usable = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    drawn = usable.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).toArrow()
    if not drawn.num_rows:
        return np.zeros((1, 1))
    vectors = _unit(_matrix(drawn.column("embedding")))
    vectors = vectors[~np.isnan(vectors).any(1)]
    if not len(vectors):
        return np.zeros((1, 1))
    distinct = np.unique(vectors, axis=0)  # a passage stored many times is one place to start from
    centroids = distinct[np.random.default_rng(0).permutation(len(distinct))[:cells]]
    for _ in range(rounds):
        own = (distinct @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, distinct)
        filled = np.linalg.norm(sums, axis=1) > 0
        centroids = np.where(filled[:, None], _unit(np.where(filled[:, None], sums, 1.0)), centroids)
    return centroids


def nearest_cells(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """The rows, whose last column is ``embedding``, with ``cell``: one row for each of the nearest cells. A vector without length has none."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CELLS vectors
    place, names = len(rows.columns) - 1, [*rows.columns, "cell"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for batch in batches:
            vectors = _unit(_matrix(batch.column(place))) if batch.num_rows else np.zeros((0, middle.shape[1]))
            usable = np.flatnonzero(~np.isnan(vectors).any(1))
            scores = vectors[usable] @ middle.T
            width = min(probes, middle.shape[0])
            cells = np.argpartition(-scores, width - 1, axis=1)[:, :width] if len(usable) else np.zeros((0, width), np.int64)
            taken = batch.take(pa.array(np.repeat(usable, width)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.ravel().astype(np.int32), pa.int32())], names)

    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(work, f"{fields}, cell int")


def index_cells(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``chunk_id, embedding, cell``, written once in order of the cells."""
    usable = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    return materialize(nearest_cells(usable, centroids, 1).repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell"), "cells")


def dense_topk_cells(
    questions: DataFrame,
    indexed: DataFrame,
    centroids: np.ndarray,
    k: int,
    probes: int,
    digits: int = 6,
    query_block: int = QUERY_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """(question_id, chunk_id, score, rank) of the best chunks in the ``probes`` cells nearest to each question.

    Question and chunk rows meet by cell, as ``grouped`` does it: neither a crowded cell nor a popular
    question gathers in one task.
    """
    asked = questions.select("question_id", "embedding").filter(F.col("embedding").isNotNull())
    looked = materialize(nearest_cells(asked, centroids, probes), "probes")
    return top_k(grouped(looked, indexed, k, digits, query_block, chunk_block), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits that were found; hits that tie with the last exact one count as found."""
    worst = exact.groupBy("question_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    hits = found.join(worst, "question_id").filter("score >= worst").groupBy("question_id").agg(F.count("*").alias("hits"))
    both = worst.join(hits, "question_id", "left").agg(F.sum(F.least("n", F.coalesce("hits", F.lit(0)))).alias("hits"), F.sum("n").alias("n")).first()
    return both["hits"] / both["n"] if both["n"] else 1.0


def probes_for(
    wanted: float, questions: DataFrame, chunks: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int
) -> tuple[int, float]:
    """The smallest number of cells, doubling from one, that reaches the wanted recall on ``questions``; and the recall."""
    exact = materialize(dense_topk(questions, chunks, k), "exact")
    for step in range(math.ceil(math.log2(len(centroids))) + 1):
        probes = min(1 << step, len(centroids))
        reached = recall(dense_topk_cells(questions, indexed, centroids, k, probes), exact)
        if reached >= wanted:
            break
    return probes, reached
