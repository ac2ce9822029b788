"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

Items are indexed by their words (lower-cased A-Z; runs of digits, letters and non-ASCII bytes). Each
document is cut into passages that overlap by half, for each width that items ask for: twice the next power
of two of an item's words, ``passage`` at least. So an item's text lies whole in a passage, and what is found for it
depends on no other item. A passage asks with its distinct words and retrieves every item whose BM25
score reaches the item's own threshold. The threshold is the lowest score that a passage can have which
holds the required shares of the item's word shingles; so nothing is missed that could be confirmed.

The search is block-max WAND, carried out for many passages together: first the sum of each word's
highest impact on any item; then, for passages that can reach a threshold, the sum of the block maxima in the
words' postings; then the exact scores inside the blocks that can. Passages move through these bounds side by
side instead of one pivot at a time. Retrieved pairs are
confirmed if the passage holds at least ``overlap`` of the five-word shingles of the question and of the
answer. The answer is what follows the last question mark, or else the last third of the words.

Words are counted over all items by Spark, and tasks build the index in shards of about ``shard`` items. It
travels in portions of at most ``portion_bytes`` (or one shard); a larger index is searched in several scans of the
documents, one after another.

Cases: null and empty texts have no passages; null items and items without words match nothing; an item
of one word has no answer part; a part of fewer than five words counts as one shingle; repeated items are
reported each under its id; repeated documents are reported each; empty tables give an empty result;
other columns are not read.
"""

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quirework.functions.common import materialize
from quirework.llm.text_bytes import BASES, LOWERED, Rolling, bounded, utf8, word_spans

RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
SHINGLE = 5
K1, B = 1.2, 0.75
WORD = np.ones(256, bool)
WORD[0x00:0x30] = WORD[0x3A:0x41] = WORD[0x5B:0x61] = WORD[0x7B:0x80] = False


def word_hashes(column: pa.Array, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    data = LOWERED[data]
    starts, ends, first = word_spans(data, offsets, WORD)
    return rolling.spans(data, starts, ends), first


def parts(text: str) -> tuple[str, str]:
    """Question and answer."""
    head, mark, tail = text.rpartition("?")
    if mark and re.search(r"\w", head) and re.search(r"\w", tail):
        return head + mark, tail
    words = text.split()
    cut = math.ceil(2 * len(words) / 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


class Shard:
    """Inverted index of some items of one width: blocked postings with normalised impacts, so that 1 is every item's threshold.

    A term's postings are the blocks of items that hold it, in order: the block, its highest impact, and
    the impacts of its items.
    """

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray, dict[int, int]]], n: int, mean: float, width: int, overlap: float, block: int) -> None:
        rolling = Rolling(BASES[0])
        self.width, self.block, self.ids = width, block, [item[0] for item in items]
        self.shingles = [tuple(shingles(side, rolling) for side in item[1:3]) for item in items]
        weights = [self.weights(item, n, mean, overlap, rolling) for item in items]
        self.terms = np.array(sorted({t for w in weights for t in w}), np.uint64)
        place = {t: k for k, t in enumerate(self.terms.tolist())}
        held = sorted((place[t], i // block, i % block, w) for i, own in enumerate(weights) for t, w in own.items())
        term, of_block, slot, weight = (np.array(c) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 4
        opens = np.flatnonzero(np.diff(term, prepend=-1).astype(bool) | np.diff(of_block, prepend=-1).astype(bool))
        entry = np.repeat(np.arange(len(opens)), np.diff(np.r_[opens, len(term)]))
        self.impacts = np.zeros((len(opens), block), np.float32)
        self.impacts[entry, slot] = weight
        self.blocks, self.block_max = of_block[opens], self.impacts.max(1, initial=0)
        self.n_blocks = -(-len(items) // block)
        self.first = np.searchsorted(term[opens], np.arange(len(self.terms) + 1))
        self.highest = np.maximum.reduceat(self.block_max, self.first[:-1]) if len(self.terms) else np.zeros(0, np.float32)
        full = [found for pair in self.shingles for width_, found in pair if width_ == SHINGLE]
        self.full = np.unique(np.concatenate(full)) if full else np.zeros(0, np.uint64)
        self.tiny = np.array([all(width_ < SHINGLE for width_, _ in pair) for pair in self.shingles], bool)
        self.term_filter, self.full_filter = prefix_filter(self.terms), prefix_filter(self.full)

    @staticmethod
    def weights(item: tuple, n: int, mean: float, overlap: float, rolling: Rolling) -> dict[int, float]:
        """BM25 weights of an item's words, by the statistics of all items, over the lowest score that can be confirmed."""
        _, question, answer, seen = item
        counts, length = Counter(np.concatenate((question, answer)).tolist()), len(question) + len(answer)
        weight = {t: math.log(1 + (n - seen[t] + 0.5) / (seen[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) for t, tf in counts.items()}
        missing = sum(may_miss(side, overlap, rolling) for side in (question, answer))
        low = sum(sorted(weight.values())[: max(1, len(weight) - missing)])
        return {t: w / low * 1.0001 for t, w in weight.items()}  # rounding must not lose a score at the threshold

    def term_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word among the indexed terms, -1 for other words."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.term_filter[hashes >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        same = self.terms[at] == hashes[maybe]
        out[maybe[same]] = at[same]
        return out

    def full_shingle_places(self, windows: np.ndarray) -> np.ndarray:
        """Places of the five-word windows that occur in some item."""
        maybe = np.flatnonzero(self.full_filter[windows >> np.uint64(48)])
        return maybe[np.isin(windows[maybe], self.full)]

    def reaching(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the passages whose highest impacts sum up to a threshold."""
        keep = (np.bincount(passage, weights=self.highest[term]) >= 1)[passage]
        return passage[keep], term[keep]

    def search(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, items and scores that reach the threshold. Words of one passage may repeat."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        known = term >= 0
        passage, term = self.reaching(passage[known], term[known])  # words that repeat only raise the sum
        both = np.sort(passage * np.int64(len(self.terms)) + term)
        both = both[np.flatnonzero(np.diff(both, prepend=-1))]
        passage, term = self.reaching(both // len(self.terms), both % len(self.terms))
        if not len(passage):
            return none
        names, owner = np.unique(passage, return_inverse=True)
        counts = self.first[term + 1] - self.first[term]
        entry = np.arange(int(counts.sum())) + np.repeat(self.first[term] - (np.cumsum(counts) - counts), counts)
        cell = np.repeat(owner, counts) * self.n_blocks + self.blocks[entry]
        open_ = (np.bincount(cell, weights=self.block_max[entry]) >= 1)[cell]
        cell, entry = cell[open_], entry[open_]
        if not len(cell):
            return none
        order = np.argsort(cell, kind="stable")
        cell, entry = cell[order], entry[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        scores = np.add.reduceat(self.impacts[entry], starts)
        c, i = np.nonzero(scores >= 1)
        hit = cell[starts[c]]
        return names[hit // self.n_blocks], hit % self.n_blocks * self.block + i, scores[c, i]


def prefix_filter(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[hashes >> np.uint64(48)] = True
    return out


def may_miss(words: np.ndarray, overlap: float, rolling: Rolling) -> int:
    """Most words of a part that a passage can lack which holds the required share of the part's shingles.

    Windows at k places cover at least k + 4 words, so no more words are missing than places.
    """
    if len(words) < SHINGLE:
        return 0
    places = np.sort(np.unique(rolling.windows(words, SHINGLE), return_counts=True)[1])[::-1]
    return int(places[: len(places) - math.ceil(overlap * len(places))].sum())


def shingles(words: np.ndarray, rolling: Rolling) -> tuple[int, np.ndarray]:
    """Shingle length of a part and its distinct shingles."""
    width = min(SHINGLE, len(words))
    return width, np.unique(rolling.windows(words, width)) if width else np.zeros(0, np.uint64)


class Searcher:
    def __init__(self, shards: list[Shard], overlap: float) -> None:
        self.shards, self.overlap, self.rolling = shards, overlap, Rolling(BASES[0])

    def held(self, words: np.ndarray, part: tuple[int, np.ndarray]) -> float:
        width, wanted = part
        if not width:
            return 1.0
        return float(np.isin(wanted, self.rolling.windows(words, width)).mean()) if len(words) >= width else 0.0

    def rows(self, column: pa.Array) -> dict[tuple[int, int], tuple[float, float, float]]:
        """Confirmed (row, item id) pairs with the best score and overlaps."""
        hashes, first = word_hashes(column, self.rolling)
        counts = np.diff(first)
        row = np.repeat(np.arange(len(counts)), counts)
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        windows = self.rolling.windows(hashes, SHINGLE)
        for shard in self.shards:
            if not len(shard.ids) or not len(hashes):
                continue
            stride = shard.width // 2
            last = np.maximum(0, -(-counts // stride) - 2)  # last passage of each row
            base = np.r_[0, np.cumsum(last + 1)]
            step = (np.arange(len(hashes)) - first[:-1][row]) // stride
            term = shard.term_numbers(hashes)
            known = np.flatnonzero(term >= 0)
            own_row, own_step, own_term = row[known], step[known], term[known]
            passages, terms = [], []
            for shift in (0, 1):  # a word lies in the passage that starts at its step and in the one before
                ok = (own_step >= shift) & (own_step - shift <= last[own_row])
                passages.append((base[own_row] + own_step - shift)[ok])
                terms.append(own_term[ok])
            p, i, scores = shard.search(np.concatenate(passages), np.concatenate(terms))
            rows = np.searchsorted(base, p, "right") - 1
            starts = first[rows] + (p - base[rows]) * stride
            stops = np.minimum(starts + shard.width, first[rows + 1])
            places = shard.full_shingle_places(windows)
            touched = np.searchsorted(places, stops) > np.searchsorted(places, starts)
            chosen = touched | shard.tiny[i]  # without any of the items' windows nothing can be confirmed
            for r, start, stop, i, score in zip(*(x[chosen].tolist() for x in (rows, starts, stops, i, scores))):
                own = hashes[start:stop]
                overlaps = [self.held(own, part) for part in shard.shingles[i]]
                if min(overlaps) >= self.overlap:
                    key = r, shard.ids[i]
                    out[key] = max(out.get(key, (0.0, 0.0, 0.0)), (score, *overlaps))
        return out


ITEMS = "key long, item_id long, width int, question array<long>, answer array<long>"


def described_items(benchmark: DataFrame, item_col: str, text_col: str, passage: int) -> DataFrame:
    """``ITEMS``: word hashes of both parts, and the width of the passages that an item is looked for in.

    The width is twice the next power of two of the item's words, ``passage`` at least, and depends on nothing else.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for batch in bounded(batches, 2):
            sides = [t for text in batch.column(2).to_pylist() for t in parts(text)]
            hashes, first = word_hashes(pa.array(sides, pa.string()), rolling)
            words = [hashes[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:])]
            sizes = [len(q) + len(a) for q, a in zip(words[::2], words[1::2])]
            kept = [i for i, n in enumerate(sizes) if n]
            lists = [pa.array([words[2 * i + k] for i in kept], pa.list_(pa.int64())) for k in (0, 1)]
            widths = pa.array([max(passage, 2 << (sizes[i] - 1).bit_length()) for i in kept], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64())), widths, *lists], ["key", "item_id", "width", "question", "answer"])

    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropna().distinct()
    return rows.select(F.xxhash64("item_id", "text"), "item_id", "text").mapInArrow(work, ITEMS)


def index_shards(benchmark: DataFrame, item_col: str, text_col: str, overlap: float, passage: int, shard: int, block: int) -> DataFrame:
    """``width, shard, payload``: the index, written once. Counts of items and words are those of all items;
    a shard holds about ``shard`` items of one width and is built in a task of its own."""
    items = materialize(described_items(benchmark, item_col, text_col, passage), "items")
    words = items.select("key", F.explode(F.array_distinct(F.concat("question", "answer"))).alias("term"))
    seen = words.groupBy("term").agg(F.count("*").alias("n"))
    of_item = words.join(seen, "term").groupBy("key").agg(F.collect_list(F.struct("term", "n")).alias("seen"))
    facts = items.agg(F.count("*").alias("n"), F.avg(F.size("question") + F.size("answer")).alias("mean")).first()
    sizes = items.groupBy("width").agg(F.ceil(F.count("*") / shard).alias("shards"))  # a row per power of two
    dealt = items.join(of_item, "key").join(sizes, "width").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    n, mean = facts["n"], facts["mean"]

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("item_id", "ascending"), ("key", "ascending")])
        own = zip(*(table.column(c).to_pylist() for c in ("item_id", "question", "answer", "seen")))
        unsigned = lambda x: np.array(x, np.int64).view(np.uint64)
        rows = [(i, unsigned(q), unsigned(a), {s["term"] % (1 << 64): s["n"] for s in found}) for i, q, a, found in own]
        payload = pickle.dumps(vars(Shard(rows, n, mean, key[0].as_py(), overlap, block)))  # its class is sent by value
        return pa.table({"width": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    return materialize(dealt.groupBy("width", "shard").applyInArrow(build, "width int, shard int, payload binary"), "index")


def searchers(
    benchmark: DataFrame, item_col: str, text_col: str, overlap: float, passage: int = 128, shard: int = 512, portion_bytes: int = 32 << 20, block: int = 16
) -> Iterator[Searcher]:
    """The index in portions of bounded bytes, each broadcast for one scan of the documents."""
    shards, held = [], 0
    for row in index_shards(benchmark, item_col, text_col, overlap, passage, shard, block).orderBy("width", "shard").toLocalIterator():
        if shards and held + len(row["payload"]) > portion_bytes:
            yield Searcher(shards, overlap)
            shards, held = [], 0
        shard_ = Shard.__new__(Shard)
        vars(shard_).update(pickle.loads(row["payload"]))
        shards.append(shard_)
        held += len(row["payload"])
    if shards:
        yield Searcher(shards, overlap)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    overlap: float = 0.8,
    passage: int = 128,
    shard: int = 512,
    portion_bytes: int = 32 << 20,
    block: int = 16,
) -> DataFrame:
    """One row per document and item that it contains."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = spark.createDataFrame([], RESULT)
    for searcher in searchers(benchmark, item_col, item_text_col, overlap, passage, shard, portion_bytes, block):
        found = found.union(rows.mapInArrow(leak_rows(spark.sparkContext.broadcast(searcher)), RESULT))
    return found


def leak_rows(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            found = shared.value.rows(batch.column(1))
            ids = batch.column(0).take(pa.array([r for r, _ in found], pa.int64()))
            scores = [pa.array([v[k] for v in found.values()], pa.float64()) for k in range(3)]
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in found], pa.int64()), *scores], names)

    return work


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item. Rows are tested where they are read."""
    spark, kind = docs.sparkSession, StructType(docs.schema.fields)
    place = docs.columns.index(text_col)

    def without(shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in bounded(batches, place):
                hit = {r for r, _ in shared.value.rows(batch.column(place))}
                yield batch.filter(pa.array([r not in hit for r in range(batch.num_rows)], pa.bool_()))

        return work

    for searcher in searchers(benchmark, item_col, item_text_col, 0.8):
        docs = docs.mapInArrow(without(spark.sparkContext.broadcast(searcher)), kind)
    return docs
