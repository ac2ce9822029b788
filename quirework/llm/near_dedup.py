"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct shingles of ``shingle`` words (lower-cased A-Z; with fewer words the
whole sequence as one). All signature coordinates come from two permutations: the first places each
shingle on a ring, the second, shifted around the ring by the coordinate's number, orders the places.
Coordinates are grouped into ``bands`` keys of ``rows``; two sets that agree in a key become candidates.
With 40 bands of 5 a pair at similarity 0.8 is missed with probability 1.2e-7.

1. Documents with equal sets form a class with its smallest id; only classes go on.
2. Per band key the smallest id leads; each member is paired with two of its leaders, the smallest and
   that of its largest key, so this step has at most two rows per class. A sketch of one byte per
   coordinate drops pairs far below the threshold (similarity 0.8 falls under 0.65 with less than 1e-7).
   The rest are confirmed on the full sets; the confirmed links give first components.
3. Band keys that still hold two components are searched for further pairs across components only, the
   members outside the largest component against all, in cells of two tiles at most. A key with more such
   members than a tile holds gives way to the rarest shingles that its documents share, by which no pair at
   the threshold is lost, while texts just under it mostly have none in common. Promising pairs are not
   listed: a cell gives a forest that joins the members of such pairs, at most one edge per member. The
   trees of all cells form neighbourhoods, and every neighbourhood compares its full sets, again across
   components and in cells, giving at most one link per component joined. Pairs inside one component
   need no test: no link that matters is lost, and neither a group of thousands of near copies nor one
   of thousands of texts just under the threshold costs a row per pair.

Full texts are fetched for candidates only, compressed on the way. Cases: null text, or text without
words, has an empty set and is linked with nothing; rows without an id are linked with nothing (null
component, not kept); rows that repeat an id share a component; an empty table gives an empty result;
other columns are not read; texts are read whole.
"""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quirework.functions.common import materialize
from quirework.llm.text_bytes import BASES, LOWERED, NOT_SPACE, Rolling, bounded, mix, release_memory, utf8, word_spans

PART = 1 << 14  # shingles handled at a time, so that work stays in the processor's cache
SET_BYTES = 6
SIZE_CLASSES = 64  # classes of set sizes per factor e


def shingle_sets(column: pa.Array, width: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and where each text's begin."""
    data, offsets = utf8(column)
    data = LOWERED[data]
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    words, counts = rolling.spans(data, starts, ends), np.diff(first)
    per_doc = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), per_doc)
    at = np.repeat(first[:-1], per_doc) + np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    hashes = np.zeros(len(owner), np.uint64)
    full = counts[owner] >= width
    for k in range(width):
        hashes[full] = hashes[full] * np.uint64(BASES[1]) + words[at[full] + k]
    short = np.flatnonzero(~full)
    for k in range(width - 1):  # one shingle of fewer words
        more = short[counts[owner[short]] > k]
        hashes[more] = hashes[more] * np.uint64(BASES[0]) + words[at[more] + k] + np.uint64(1)
    hashes = mix(hashes) >> np.uint64(64 - 8 * SET_BYTES)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def set_bytes(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]


def signatures(hashes: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: (texts, coordinates) smallest values; texts with an empty set have the largest."""
    out = np.full((len(first) - 1, coordinates), np.iinfo(np.uint32).max, np.uint32)
    filled = np.flatnonzero(np.diff(first) > 0)
    places = (mix(hashes) >> np.uint64(32)).astype(np.uint32)  # the first permutation, onto a ring of 2^32
    i = 0
    while i < len(filled):
        j = max(i + 1, int(np.searchsorted(first[filled + 1], first[filled[i]] + PART, "right")))
        a, b = first[filled[i]], first[filled[j - 1] + 1]
        ring, cuts = places[a:b], first[filled[i:j]] - a
        x, y = np.empty_like(ring), np.empty_like(ring)
        for k in range(coordinates):
            np.add(ring, np.uint32(k), out=x)  # shifted around the ring
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):  # the second permutation
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[filled[i:j], k] = np.minimum.reduceat(x, cuts)
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(BASES[1]), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys + parts[:, :, k] * np.uint64(BASES[0]))
    return keys


def describe(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, set_id, bands, sketch`` per row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for batch in bounded(batches, 1):
            hashes, first = shingle_sets(batch.column(1), shingle, rolling)
            raw = set_bytes(hashes)
            ids = [blake2b(raw[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]
            signature = signatures(hashes, first, bands * rows)
            keys = band_keys(signature, bands, rows).astype(np.int64)
            flat = pa.array(keys.ravel())
            sketch = signature.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(first)),
                    pa.array(ids, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), flat),
                    pa.array([row.tobytes() for row in sketch], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_id", "bands", "sketch"],
            )

    return docs.mapInArrow(work, "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch binary")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches: equal bytes, less those that agree by chance."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint8)


def sized(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose sizes, as a column states them, sum up to at most ``most``, or single rows."""
    reach, at = np.cumsum(batch.column(column).to_numpy()), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
    release_memory()


def promising(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` whose sketches agree enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = agreement(stacked(batch.column(2)), stacked(batch.column(3))) >= least
            yield batch.select(["a", "b"]).filter(pa.array(good))

    sketch = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("x"))
    other = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(sketch, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def full_sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``rep, members``: the whole sets of the documents in ``ids`` (rep); other texts are not unpacked."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in bounded(batches, 1):
            texts = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            packed = [codec.compress(t, asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(packed, pa.binary())], ["rep", "size", "packed"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rolling = pa.Codec("zstd"), Rolling(BASES[0])
        for batch in batches:
            for part in sized(batch, 1):
                texts = [codec.decompress(p, n, asbytes=True) for p, n in zip(part.column(2).to_pylist(), part.column(1).to_pylist())]
                hashes, first = shingle_sets(pa.array(texts, pa.binary()).cast(pa.string()), shingle, rolling)
                raw = set_bytes(hashes)
                sets = [raw[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["rep", "members"])

    packed = docs.mapInArrow(pack, "rep long, size long, packed binary")
    return materialize(packed.join(ids, "rep").select("rep", "size", "packed").mapInArrow(to_sets, "rep long, members binary"), "sets")


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").ravel()


def similar(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (shared > 0) & (100 * shared >= percent * (a + b - shared))


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = unpacked(x.as_py()), unpacked(y.as_py())
                both = np.sort(np.concatenate((a, b)))
                good.append(bool(similar(int((both[1:] == both[:-1]).sum()), len(a), len(b), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = full_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), docs, shingle)
    first = sets.select(F.col("rep").alias("a"), F.col("members").alias("x"))
    second = sets.select(F.col("rep").alias("b"), F.col("members").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


class Forest:
    """Trees over numbered nodes, grown by joining one node with many at a time."""

    def __init__(self, roots: np.ndarray) -> None:
        self.roots = roots.copy()
        self.edges: list[tuple[int, int]] = []

    def join(self, node: int, others: np.ndarray) -> None:
        roots, at = np.unique(self.roots[others], return_index=True)
        new = roots != self.roots[node]
        if new.any():
            self.edges += [(int(node), int(j)) for j in others[at[new]]]
            self.roots[np.isin(self.roots, roots)] = self.roots[node]

    def pairs(self, ids: np.ndarray) -> pa.Table:
        ends = ids[np.array(self.edges, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(ends.max(1)), "b": pa.array(ends.min(1))})


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``rep, component``: smallest id reachable over ``links`` (a, b), for every id in a link or in ``labels``.

    Each round points every node at the first of itself and its neighbours and draws together what points
    to one node, so links between joined nodes vanish. The order is that of the ids at first, which suits
    leaders, and then another hash in each round, so that long chains shrink by a constant share.
    """
    if labels is not None:  # links between components so far
        one, two = (labels.select(F.col("rep").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        links = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    links = distinct_links(links)
    nodes = materialize(links.select(F.col("a").alias("rep")).union(links.select("b")).distinct().withColumn("component", F.col("rep")), "components")
    turn = 0
    while not links.isEmpty():
        place = lambda node: F.struct((F.xxhash64(node, F.lit(turn)) if turn > 1 else F.col(node)).alias("order"), F.col(node).alias("node"))  # noqa: E731, B023
        both = links.union(links.select("b", "a"))
        to = materialize(both.groupBy("a").agg(F.least(place("a"), F.min(place("b")))["node"].alias("to")), "pointers")
        nodes = nodes.join(to.withColumnRenamed("a", "component"), "component", "left").select("rep", F.coalesce("to", "component").alias("component"))
        drawn = links.join(to.withColumnRenamed("to", "x"), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        links, turn = distinct_links(drawn.select(F.col("x").alias("a"), F.col("y").alias("b"))), turn + 1
    named = nodes.groupBy("component").agg(F.min("rep").alias("least"))
    state = materialize(nodes.join(named, "component").select("rep", F.col("least").alias("component")), "components")
    if labels is None:
        return state
    moved = state.select(F.col("rep").alias("component"), F.col("component").alias("further"))
    old = labels.join(moved, "component", "left").select("rep", F.coalesce("further", "component").alias("component"))
    return materialize(old.union(state.join(labels, "rep", "left_anti")), "components")


def distinct_links(links: DataFrame) -> DataFrame:
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return materialize(ends.distinct(), "links")


def neighbourhoods(groups: DataFrame, classes: DataFrame, least: float, percent: int, tile: int) -> DataFrame:
    """Edges ``a, b`` that connect all documents with a promising pair across components in a group of ``groups``."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        ids, comps, sizes, left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "n_shingles", "left", "right"))
        sketches, rights = stacked(table.column("sketch")), np.flatnonzero(right)
        forest = Forest(np.arange(len(ids)))
        for i in np.flatnonzero(left):
            fits = 100 * np.minimum(sizes[rights], sizes[i]) >= percent * np.maximum(sizes[rights], sizes[i])
            other = rights[fits & (comps[rights] != comps[i]) & (forest.roots[rights] != forest.roots[i])]
            forest.join(i, other[agreement(sketches[other], sketches[i]) >= least])
        return forest.pairs(ids)

    rows = cells(groups, group_plan(groups, "key"), "key", tile).join(classes.select("rep", "sketch", "n_shingles"), "rep")
    return rows.groupBy("key", "row", "column").applyInArrow(work, "a long, b long").distinct()


def mixed_groups(members: DataFrame, labels: DataFrame, docs: DataFrame, shingle: int, percent: int, tile: int) -> DataFrame:
    """``key, rep, component, part``: groups of documents in which to look for pairs across components and parts.

    These are the band keys that hold two components. A key with more than a tile of documents outside its
    largest component is replaced by the shingles that its documents share among their rarest ones.
    """
    placed = members.join(labels, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    held = materialize(placed.join(mixed, "key").withColumn("part", F.col("component")), "mixed")
    crowded = materialize(group_plan(held, "key").where(F.col("minor") > tile).select("key"), "crowded")
    if crowded.isEmpty():
        return held
    reps = materialize(held.join(crowded, "key", "left_semi").select("rep", "component").distinct(), "crowd")
    rare = prefix_keys(full_sets(reps.select("rep"), docs, shingle), percent).join(reps, "rep").select("key", "rep", "component", F.coalesce("part", "component").alias("part"))
    return materialize(held.join(crowded, "key", "left_anti").union(rare), "mixed")


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """``key, rep, part``: two sets that are similar enough share a key, in parts that differ or are null.

    Shingles are ordered from the rarest among these sets. With a shingles against b and s of them shared, the
    first a - s + 1 of one set and the first b - s + 1 of the other have one in common; s follows from the
    sizes, so a key is a shingle with a pair of size classes, and its parts are these classes. A shingle that one set alone holds takes its
    place in the order but gives no key.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                members = unpacked(raw).astype(np.int64)
                for at in range(0, len(members), PART):
                    part = members[at : at + PART]
                    columns = [np.full(len(part), rep), np.full(len(part), len(members)), part]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "size", "shingle"])

    single = sets.mapInArrow(work, "rep long, size long, shingle long")
    shared = single.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = single.join(shared, "shingle")
    order, whole = Window.partitionBy("rep").orderBy("n", "shingle"), Window.partitionBy("rep")
    place = F.col("size") - F.count("*").over(whole) + F.row_number().over(order)  # from 1, after the set's own shingles
    size_class = lambda size: F.floor(F.log(size) * SIZE_CLASSES).cast("int")
    size, least = F.col("size"), F.ceil(F.col("size") * percent / 100)
    classes = F.sequence(size_class(size * percent / 100), size_class(size * 100 / percent))
    partner = F.greatest(least, F.ceil(F.exp(F.col("other") / SIZE_CLASSES) - 1e-6))
    prefix = lambda partner: size - F.ceil((size + partner) * percent / (100 + percent)) + 1
    near = common.select("rep", "shingle", "size", place.alias("place")).where(F.col("place") <= prefix(least))
    spread = near.withColumn("own", size_class(size)).withColumn("other", F.explode(classes)).where(F.col("place") <= prefix(partner))
    part = F.when(F.col("own") != F.col("other"), F.col("own").cast("long")).alias("part")
    return spread.select(F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "rep", part)


def group_plan(placed: DataFrame, group: str) -> DataFrame:
    """Per group of at least two parts its largest part (``head``), its size and the number outside the largest."""
    sums = placed.groupBy(group, "part").agg(F.count("*").alias("n")).groupBy(group)
    head = F.max_by("part", F.struct("n", "part")).alias("head")
    return sums.agg(head, F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("minor")).where("minor > 0")


def cells(placed: DataFrame, plan: DataFrame, group: str, tile: int) -> DataFrame:
    """``group, row, column, rep, component, left, right``: what is outside the largest part against all.

    Both sides are dealt into tiles of about ``tile`` documents, so that a cell has about two tiles at most.
    """
    counts = plan.select(group, "head", F.ceil(F.col("minor") / tile).cast("int").alias("rows"), F.ceil(F.col("n") / tile).cast("int").alias("columns"))
    dealt = placed.join(counts, group).withColumn("x", F.when(F.col("part") != F.col("head"), tile_of("rep", "rows"))).withColumn("y", tile_of("rep", "columns"))
    # a document stands in its column of every row, and one outside the largest part in every column of its row
    columns = F.transform(numbers("rows"), lambda x: F.struct(x.alias("row"), F.col("y").alias("column")))
    rows = F.when(F.col("x").isNotNull(), F.transform(numbers("columns"), lambda y: F.struct(F.col("x").alias("row"), y.alias("column"))))
    spread = dealt.withColumn("cell", F.explode(F.array_distinct(F.concat(columns, F.coalesce(rows, F.slice(columns, 1, 0))))))
    row, column = F.col("cell.row"), F.col("cell.column")
    left, right = F.coalesce(F.col("x") == row, F.lit(False)), F.col("y") == column
    return spread.select(group, row.alias("row"), column.alias("column"), "rep", "component", left.alias("left"), right.alias("right"))


def tile_of(column: str, tiles: str):
    return F.pmod(F.xxhash64(column), F.col(tiles)).cast("int")


def numbers(count: str):
    return F.sequence(F.lit(0), F.col(count) - 1)


def cross_links(edges: DataFrame, labels: DataFrame, docs: DataFrame, shingle: int, percent: int, tile: int) -> DataFrame:
    """Links ``a, b`` across components inside the neighbourhoods that ``edges`` connect, found on the full sets."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        ids, comps, left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "left", "right"))
        sets = [unpacked(m) for m in table.column("members").to_pylist()]
        sizes = np.array([len(m) for m in sets])
        words, at = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.r_[0, np.cumsum(sizes)]
        rights = np.flatnonzero(right)
        flat = np.concatenate([at[cuts[j] : cuts[j + 1]] for j in rights]) if len(rights) else at[:0]
        begins = np.r_[0, np.cumsum(sizes[rights])][:-1]
        held = np.zeros(len(words), np.int32)
        forest = Forest(np.unique(comps, return_inverse=True)[1])
        for i in np.flatnonzero(left):
            open_ones = forest.roots[rights] != forest.roots[i]
            if not open_ones.any():
                continue
            own = at[cuts[i] : cuts[i + 1]]
            held[own] = 1
            shared = np.add.reduceat(held[flat], begins)
            held[own] = 0
            forest.join(i, rights[open_ones & similar(shared, sizes[i], sizes[rights], percent)])
        return forest.pairs(ids)

    areas = components(edges).withColumnRenamed("component", "area")
    placed = areas.join(labels, "rep", "left").select("area", "rep", F.coalesce("component", "rep").alias("component"))
    placed = placed.withColumn("part", F.col("component"))
    sets = full_sets(areas.select("rep"), docs, shingle)
    rows = cells(placed, group_plan(placed, "area"), "area", tile).join(sets, "rep")
    return rows.groupBy("area", "row", "column").applyInArrow(work, "a long, b long").distinct()


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 5,
    tile: int = 2048,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = materialize(describe(texts, shingle, bands, rows), "signatures")
    least = percent / 100 - 0.15
    # min over structs keeps the partial sums of a large class small and needs no second pass
    classes = materialize(
        described.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")),
        "classes",
    )
    keyed = classes.select(F.explode("bands").alias("key"), "rep")
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(leaders, "key"), "members")
    chosen = members.where("rep <> leader").groupBy(F.col("rep").alias("a")).agg(
        F.min("leader").alias("first"), F.max_by("leader", F.struct("n", "leader")).alias("popular")
    )
    stars = chosen.select("a", F.explode(F.array_distinct(F.array("first", "popular"))).alias("b"))
    starred = materialize(promising(stars, classes, least), "pairs")
    labels = components(confirm(starred, texts, shingle, percent))
    groups = mixed_groups(members, labels, texts, shingle, percent, tile)
    edges = materialize(neighbourhoods(groups, classes, least, percent, tile), "neighbourhoods")
    if not edges.isEmpty():
        labels = components(cross_links(edges, labels, texts, shingle, percent, max(1, tile // 4)), labels)
    named = classes.select("set_id", "rep").join(labels, "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return (
        described.select("doc_id", "n_shingles", "set_id")
        .join(named, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, component).otherwise(F.col("doc_id")).alias("component_id"),
            F.coalesce(F.when(F.col("n_shingles") > 0, component == F.col("doc_id")), F.col("doc_id").isNotNull()).alias("kept"),
        )
    )
