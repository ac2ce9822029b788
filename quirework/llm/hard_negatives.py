"""Hard negatives by threshold joins in the manner of L2AP.

Vectors become whole numbers and meet in cells: a block of rows by hash and a block of anchors, both of
bounded size. Inside a cell the dimensions stand in order of rising energy, in groups. Under a threshold t (a
score per unit of the anchor's norm) a row leaves out of the index its first groups for as long as their
norm stays below t: alone they can't reach the threshold. Postings of a group hold the rows that index it.

Anchors are matched against the index from its last group to its first. Each step adds to the partial
scores, and a row is dropped when no anchor of the tile can still reach its threshold: partial score plus
the product of the remaining norms. What is left is scored in full. Thresholds start high and are lowered
until every window of the anchor is full or nothing lies below, so each cell returns its own first rows
whole; Spark takes the first of all cells.

Two joins: over rows of the anchor's label (its positives), then over rows of other labels, in the windows
that the positives' scores give.

Cases: rows without id or label, without a vector, or with a null, NaN or infinite component take no part;
shorter vectors count as filled with zeros; rows that repeat an id are rows of their own, but no row with
the anchor's id is its positive, and an anchor row that is repeated as a whole is one anchor; an anchor without
positives has no rows; scores tie by the smaller id; an empty table gives an empty result; other columns
are not read. Components from 2^26 on are refused: sums of their products would not be exact.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions.common import materialize

GROUPS = 8
TILE = 32
FOUND = pa.schema([("anchor_id", pa.int64()), ("anchor_sign", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "anchor_id long, anchor_sign long, window int, id long, score long"
MOST = 1 << 26


def matrix(column: pa.ChunkedArray, scale: float, width: int | None = None) -> np.ndarray:
    """Components as whole numbers in doubles, floor(scale * x), a row per vector, filled with zeros."""
    vectors = column.combine_chunks()
    cuts = np.asarray(vectors.offsets, np.int64)
    flat = np.floor(scale * np.asarray(vectors.values, np.float64))[cuts[0] : cuts[-1]]
    if len(flat) and np.abs(flat).max() >= MOST:
        raise ValueError(f"a scaled component is {MOST} or more: scores would not be exact")
    lengths = np.diff(cuts)
    out = np.zeros((len(lengths), max(width or 0, int(lengths.max(initial=0)))))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(cuts[:-1] - cuts[0], lengths)] = flat
    return out


class SuffixIndex:
    """The groups of dimensions that rows index under one threshold."""

    def __init__(self, rows: "Rows", threshold: float) -> None:
        self.rows = rows
        left_out = (rows.before[:, 1:] < threshold).sum(1)  # groups that a row leaves out, from the first
        order = np.argsort(left_out, kind="stable")
        self.postings = []
        for g, cut in enumerate(rows.cuts):
            holders = order[: int(np.searchsorted(left_out[order], g, "right"))]
            self.postings.append((holders, rows.values[holders, cut]))

    def reached(self, anchors: "Anchors", thresholds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per anchor: rows that score at least its threshold, and their scores."""
        rows, n_groups = self.rows, len(self.postings)
        alive = self.postings[-1][0] if n_groups else np.zeros(0, np.int64)
        partial, final = np.zeros((len(thresholds), len(alive))), []
        place = np.arange(len(alive))  # of the alive rows in the last postings list
        for g in range(n_groups - 1, -1, -1):
            holders, values = self.postings[g]
            inside = int(np.searchsorted(place, len(holders)))  # postings lists are prefixes of one another
            if inside < len(place):  # these rows index nothing further: what is left of them is a prefix
                final.append(alive[inside:][self.hopeful(anchors, thresholds, partial[:, inside:], alive[inside:], g + 1)])
                alive, place, partial = alive[:inside], place[:inside], partial[:, :inside]
            if not len(alive):
                break
            partial = partial + anchors.values[:, rows.cuts[g]] @ values[place].T
            keep = self.hopeful(anchors, thresholds, partial, alive, g)
            if keep.mean() < 0.75:
                alive, place, partial = alive[keep], place[keep], partial[:, keep]
        final.append(alive)
        rest = np.concatenate(final) if final else alive
        scores = anchors.values @ rows.values[rest].T
        for i, t in enumerate(thresholds):
            good = np.flatnonzero(scores[i] >= t)
            yield i, rest[good], scores[i, good]

    def hopeful(self, anchors: "Anchors", thresholds: np.ndarray, partial: np.ndarray, alive: np.ndarray, g: int) -> np.ndarray:
        """Rows that some anchor may still reach: the first g groups add at most the product of their norms."""
        bound = partial + anchors.before[:, g, None] * self.rows.before[alive, g]
        return (bound * (1 + 1e-12) + 1e-3 >= thresholds[:, None]).any(0)


class Rows:
    """Rows of a block with dimensions in order of rising energy; ``before[:, g]`` is the norm of the first g groups."""

    def __init__(self, values: np.ndarray, order: np.ndarray | None = None) -> None:
        self.order = np.argsort((values * values).sum(0), kind="stable") if order is None else order
        self.values = np.ascontiguousarray(values[:, self.order])
        width = self.values.shape[1]
        edges = np.unique(np.linspace(0, width, min(GROUPS, width) + 1).astype(int))
        self.cuts = [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        squares = np.column_stack([np.zeros(len(values)), *((self.values[:, c] ** 2).sum(1) for c in self.cuts)])
        self.before = np.sqrt(np.cumsum(squares, 1))

    def norms(self) -> np.ndarray:
        return self.before[:, -1]


Anchors = Rows


def subset(rows: Rows, which: np.ndarray) -> Rows:
    out = Rows.__new__(Rows)
    out.order, out.cuts, out.values, out.before = rows.order, rows.cuts, rows.values[which], rows.before[which]
    return out


def lowered(rows: Rows, anchors: Anchors, first: np.ndarray, least: np.ndarray, factor: float, accept: Callable[[int, np.ndarray, np.ndarray], bool]) -> None:
    """Join with thresholds from ``first`` down to ``least`` per anchor, until ``accept(anchor, rows, scores)`` is content."""
    open_, now, norms = np.arange(len(first)), np.maximum(first, least), anchors.norms()
    while len(open_):
        open_ = open_[np.argsort(now[open_] / np.maximum(norms[open_], 1e-9), kind="stable")]
        index = SuffixIndex(rows, float(now[open_[0]] / max(norms[open_[0]], 1e-9)))
        left = []
        for at in range(0, len(open_), TILE):
            tile = open_[at : at + TILE]
            for i, found, scores in index.reached(subset(anchors, tile), now[tile]):
                if not accept(int(tile[i]), found, scores) and now[tile[i]] > least[tile[i]]:
                    left.append(tile[i])
        open_ = np.array(left, np.int64)
        now[open_] = np.where(now[open_] * factor > np.maximum(least[open_], norms[open_] * 0.02 * rows.norms().max(initial=0)), now[open_] * factor, least[open_])


def clean_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, vector`` of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite
    )


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Callable[[Column], Column],
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: float = 256,
    positives: int = 5,
    negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
    block_bytes: int = 16 << 20,
    least_blocks: int = 64,
    least_rows: int = 2048,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its
    first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score is at
    least ``percent[0]`` and at most ``percent[1]`` hundredths of the positive's. ``is_anchor`` is a condition on the id."""
    taking_part = clean_rows(rows, id_col, vector_col, label_col)
    anchors = taking_part.where(is_anchor(F.col("id"))).distinct()
    signed = materialize(anchors.select("id", F.xxhash64("label", "vector").alias("sign"), "label", "vector"), "anchors")
    size = taking_part.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = size["n"], max(size["width"] or 1, 1)
    most_rows = max(1, block_bytes // (8 * width))
    n_blocks = max(-(-n // most_rows), min(least_blocks, n // least_rows), 1)
    n_anchor_blocks = signed.count() // most_rows + 1
    dealt_rows = taking_part.select(
        F.pmod(F.xxhash64("id", "vector"), F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_anchor_blocks - 1))).alias("part"), "id", "label", "vector",
    )

    def cells(anchor_rows: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
        dealt = anchor_rows.select(
            F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
            F.pmod(F.xxhash64("id", "sign"), F.lit(n_anchor_blocks)).cast("int").alias("part"), "*",
        )
        return dealt_rows.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(work, FOUND_DDL)

    def table(anchor_table: pa.Table, found: list[tuple]) -> pa.Table:
        """``found`` holds (anchor, window, ids, scores)."""
        if not found:
            return FOUND.empty_table()
        ids, signs = (anchor_table.column(c).to_numpy() for c in ("id", "sign"))
        at = np.repeat([f[0] for f in found], [len(f[2]) for f in found])
        columns = [ids[at], signs[at], np.repeat([f[1] for f in found], [len(f[2]) for f in found]), *(np.concatenate([f[k] for f in found]) for k in (2, 3))]
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, FOUND)], schema=FOUND)

    def loaded(rows_table: pa.Table, anchor_table: pa.Table) -> tuple:
        block, asked = matrix(rows_table.column("vector"), scale), matrix(anchor_table.column("vector"), scale)
        wide = max(block.shape[1], asked.shape[1], 1)
        block, asked = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (block, asked))
        of_rows = Rows(block)
        numbers = [t.column(c).to_numpy() for t in (rows_table, anchor_table) for c in ("id", "label")]
        return of_rows, Rows(asked, of_rows.order), *numbers

    def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        if len(ids) > 4 * k:  # ties of the k-th stay in
            keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
        return np.lexsort((ids, -scores))[:k]

    def find_positives(rows_table: pa.Table, anchor_table: pa.Table) -> pa.Table:
        if not rows_table.num_rows or not anchor_table.num_rows:
            return FOUND.empty_table()
        of_rows, of_anchors, ids, labels, anchor_ids, anchor_labels = loaded(rows_table, anchor_table)
        found: dict[int, tuple] = {}
        for label in np.unique(anchor_labels):
            own, asking = np.flatnonzero(labels == label), np.flatnonzero(anchor_labels == label)
            same, asked = subset(of_rows, own), subset(of_anchors, asking)

            def accept(i: int, at: np.ndarray, scores: np.ndarray) -> bool:
                others = ids[own[at]] != anchor_ids[asking[i]]
                at, scores = own[at[others]], scores[others]
                first = best(ids[at], scores, positives)
                found[int(asking[i])] = (int(asking[i]), 0, ids[at[first]], scores[first])
                return len(at) >= positives

            start = 0.7 * asked.norms() * same.norms().max(initial=0)
            lowered(same, asked, start, np.full(len(asking), -np.inf), 0.7, accept)
        return table(anchor_table, list(found.values()))

    found = cells(signed, find_positives)
    order = Window.partitionBy("anchor_id", "anchor_sign").orderBy(F.desc("score"), "id")
    firsts = found.withColumn("window", F.row_number().over(order)).where(F.col("window") <= positives)
    of_positives = materialize(firsts, "positives")
    scores = of_positives.groupBy("anchor_id", "anchor_sign").agg(F.array_sort(F.collect_list(F.struct("window", "score"))).alias("wanted"))
    asked = signed.join(scores, (F.col("id") == F.col("anchor_id")) & (F.col("sign") == F.col("anchor_sign"))).select(
        "id", "sign", "label", "vector", F.transform("wanted", lambda w: w["score"]).alias("wanted")
    )
    low, high = percent

    def find_negatives(rows_table: pa.Table, anchor_table: pa.Table) -> pa.Table:
        if not rows_table.num_rows or not anchor_table.num_rows:
            return FOUND.empty_table()
        of_rows, of_anchors, ids, labels, _, anchor_labels = loaded(rows_table, anchor_table)
        wanted = [np.array(w, np.int64) for w in anchor_table.column("wanted").to_pylist()]
        windows = [[(k + 1, -(-low * s // 100), high * s // 100) for k, s in enumerate(w.tolist()) if low * s <= high * s] for w in wanted]
        asking = np.array([i for i, w in enumerate(windows) if w], np.int64)
        found: dict[int, list[tuple]] = {}

        def accept(i: int, at: np.ndarray, scores: np.ndarray) -> bool:
            anchor = int(asking[i])
            other = labels[at] != anchor_labels[anchor]
            at, scores = at[other], scores[other]
            out, full = [], True
            for number, least, most in windows[anchor]:
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                first = inside[best(ids[at[inside]], scores[inside], negatives)]
                out.append((anchor, number, ids[at[first]], scores[first]))
                full &= len(first) == negatives
            found[anchor] = out
            return full

        least = np.array([min(w[1] for w in windows[i]) for i in asking], float)
        start = np.array([0.9 * max(w[2] for w in windows[i]) for i in asking], float)
        lowered(of_rows, subset(of_anchors, asking), start, least, 0.85, accept)
        return table(anchor_table, [w for i in sorted(found) for w in found[i]])

    in_windows = cells(asked, find_negatives)
    order = Window.partitionBy("anchor_id", "anchor_sign", "window").orderBy(F.desc("score"), "id")
    ranked = in_windows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = of_positives.select("anchor_id", "anchor_sign", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor_id", "anchor_sign", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


QUERY_SQL = """WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM part a JOIN part r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 10"""
