"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of a text are rows of a sparse token-byte incidence matrix, one matrix per tokenizer, kept by hand as
compressed rows (``Rows``: where each row begins, and the columns of all rows). Gustavson's product takes the
rows of A one after another and adds up the rows of B transposed that their columns name: A times B transposed
holds, for tokens that share bytes, how many. Its entries are the overlap links; those whose tokens end at the
same byte are the links that are counted. Where both end, a group of tokens ends, too; the group-token
incidence matrices of both sides have a group's ids as rows, and the product over groups (``shared_group_links``)
links all tokens of a group, row by row.

Texts are encoded by their parts: a part begins at a space between two visible characters. Neither
tokenizer has a token that crosses such a place, so a text's ids are those of its parts in order, and parts may
be encoded together in any company. The distinct parts of many texts are found by hash, written one after another
and encoded as a few long strings, whose ids are dealt to the parts by the lengths of their bytes.

Documents are read in blocks of bounded bytes. A block writes its distinct id pairs with their counts once, and
per document the places of its pairs in that list. Spark sums the pairs of all blocks, finds the highest count
of each id of the second tokenizer, and joins both back to the blocks, salted, since a frequent pair is in every
block. So a pair is sent once per block, not once per link, and no vocabulary is broadcast.

Cases: a null or empty text, and one that a tokenizer doesn't give back byte for byte, has no tokens; repeated
rows count each; one text of any length is handled in one task, its product in slices; an empty table gives an
empty result; other columns are not read.
"""

import hashlib
import json
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quirework.functions.common import materialize
from quirework.llm.text_bytes import BASES, Rolling, bounded, release_memory, utf8

SPACE_MARK = "▁"
STORE = "alignment_tokenizers"
JOINED = 1 << 13  # bytes of parts that are encoded as one string
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how a byte-level tokenizer cuts words
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SLICE = 1 << 18
PAIR_BASE = 1 << 20  # a pair of ids as one number: a * PAIR_BASE + b
BLOCK_BITS = 32


def byte_level_bytes(entry: str) -> bytes:
    """A byte-level entry's bytes: printable Latin-1 signs stand for themselves, the other bytes for U+0100 and up, in order."""
    return bytes(BYTE_OF[c] for c in entry)


PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in PLAIN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE_MARK, " ").encode()


class Vocabulary:
    """Token bytes of all ids, one after another; ``starts`` has one entry more than ids."""

    def __init__(self, entries: list[bytes]) -> None:
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        first = np.cumsum(lengths) - lengths
        return self.data[np.arange(int(lengths.sum())) + np.repeat(self.starts[ids] - first, lengths)]


class ByteLevel:
    """Side A: a byte-level tokenizer; parts keep their leading space.

    The file's own vocabulary and merges run in the faster of the two engines: merges in order of rank, where the
    n-th merge makes the n-th id after the 256 bytes. Strings of special tokens are plain text.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        model, cutter = settings["model"], settings["pre_tokenizer"]
        special = {t["content"] for t in settings["added_tokens"]}
        made = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        in_order = all(model["vocab"]["".join(m)] == 256 + i for i, m in enumerate(made))
        if cutter != BYTE_LEVEL or settings["normalizer"] or not in_order:
            raise ValueError(f"{path} is not a byte-level tokenizer whose ids follow its merges")
        ranks = {byte_level_bytes(name): number for name, number in model["vocab"].items() if name not in special}
        entries = [b""] * (max(model["vocab"].values()) + 1)
        for raw, number in ranks.items():
            entries[number] = raw
        self.vocabulary = Vocabulary(entries)
        self.engine = tiktoken.Encoding("byte level", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.engine.encode_ordinary(t) for t in texts]


class Pieces:
    """Side B: a sentence-piece tokenizer; it puts a space before a text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.engine = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.engine.id_to_piece(i) for i in range(self.engine.get_piece_size())]
        if any(SPACE_MARK in n.lstrip(SPACE_MARK) for n in names):
            raise ValueError("a piece crosses a space: texts can't be encoded by their parts")
        kept = [not (self.engine.is_control(i) or self.engine.is_unknown(i)) for i in range(len(names))]
        self.vocabulary = Vocabulary([piece_bytes(n) if k else b"" for n, k in zip(names, kept)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.engine.encode([t[1:] for t in texts], num_threads=1)


def loaded(kind: type, path: str):
    """One tokenizer per worker process."""
    store = sys.modules.setdefault(STORE, types.ModuleType(STORE)).__dict__  # functions are sent by value, so globals end with the task
    if (kind.__name__, path) not in store:
        store[kind.__name__, path] = kind(path)
    return store[kind.__name__, path]


def led_by_space(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts that are not empty, a space before each; and their offsets, empty texts included."""
    data, offsets = utf8(column)
    lengths = np.diff(offsets)
    new = np.r_[0, np.cumsum(lengths + (lengths > 0))]
    out = np.full(int(new[-1]), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(lengths > 0), lengths)] = data
    return out, new


# White space beyond ASCII begins with one of the bytes C2, E1, E2, E3 and ends with one of 80-8A, 85, 9F, A0, A8, A9, AF.
ENDS_VISIBLE, BEGINS_VISIBLE = (np.zeros(256, bool) for _ in range(2))
ENDS_VISIBLE[0x21:0x7F] = ENDS_VISIBLE[0x80:] = BEGINS_VISIBLE[0x21:0x7F] = BEGINS_VISIBLE[0x80:] = True
ENDS_VISIBLE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
BEGINS_VISIBLE[[0xC2, 0xE1, 0xE2, 0xE3]] = False


class Parts:
    """The distinct parts of texts that each begin with a space.

    A part begins at each text's first byte, and at a space between two characters that are surely visible.
    Parts that also begin and end so, and hold no space mark, may be joined; the others stay alone.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> None:
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 32) & ENDS_VISIBLE[data[:-2]] & BEGINS_VISIBLE[data[2:]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(data)]
        _, at, which = np.unique(rolling.spans(data, starts, ends), return_index=True, return_inverse=True)
        a, b = starts[at], ends[at]
        joins = (b - a > 1) & BEGINS_VISIBLE[data[np.minimum(a + 1, max(len(data) - 1, 0))]] & ENDS_VISIBLE[data[b - 1]]
        marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        joins &= np.searchsorted(marks, a) == np.searchsorted(marks, b)
        order = np.argsort(~joins, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.first, self.which = np.searchsorted(starts, offsets), place[which]  # each text's first part; each part's distinct one
        a, b, n = a[order], b[order], int(joins.sum())
        lengths = b[:n] - a[:n]
        self.reach = np.cumsum(lengths)
        text = data[np.arange(int(lengths.sum())) + np.repeat(a[:n] - (self.reach - lengths), lengths)]
        edges = np.searchsorted(self.reach, np.arange(JOINED, int(lengths.sum()), JOINED))
        cuts = np.unique(np.r_[0, self.reach[edges], lengths.sum()])
        self.joined = [text[x:y].tobytes().decode() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        self.alone = [data[x:y].tobytes().decode() for x, y in zip(a[n:].tolist(), b[n:].tolist())]


class Encoder:
    """Ids of whole texts from the ids of their distinct parts."""

    def __init__(self, kind: type, path: str) -> None:
        self.side = loaded(kind, path)

    def ids(self, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's first one."""
        lists = self.side.encode(parts.joined)
        together = np.array(list(chain.from_iterable(lists)), np.int64)
        ends = np.cumsum(self.side.vocabulary.lengths[together])
        last = np.searchsorted(ends, parts.reach)
        if len(last) and not (ends[last] == parts.reach).all():
            raise ValueError("a token crosses a space between two words")
        others = self.side.encode(parts.alone)
        counts = np.r_[np.diff(np.r_[-1, last]), np.array([len(x) for x in others], np.int64)].astype(np.int64)
        flat = np.r_[together, np.array(list(chain.from_iterable(others)), np.int64)]
        own = counts[parts.which]
        reach = np.cumsum(own)
        ids = flat[np.repeat((np.cumsum(counts) - counts)[parts.which] - (reach - own), own) + np.arange(int(own.sum()))]
        return ids, np.r_[0, reach][parts.first]


class Rows:
    """A sparse matrix of ones by its rows."""

    def __init__(self, first: np.ndarray, columns: np.ndarray) -> None:
        self.first, self.columns = first, columns


def product(a: Rows, b: Rows, begin: int, end: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's product for rows ``begin`` to ``end`` of a: row, column, value of each entry that is not 0."""
    lo, hi = a.first[begin], a.first[end]
    named = a.columns[lo:hi]
    of_row = np.repeat(np.arange(begin, end), np.diff(a.first[begin : end + 1]))
    counts = b.first[named + 1] - b.first[named]
    reach = np.cumsum(counts)
    places = np.arange(int(counts.sum())) + np.repeat(b.first[named] - (reach - counts), counts)
    keys = np.repeat(of_row, counts) * width + b.columns[places]
    if len(keys) and (np.diff(keys) < 0).any():  # an accumulator per row would sort its columns
        keys = np.sort(keys)
    firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts] // width, keys[firsts] % width, np.diff(np.r_[firsts, len(keys)])


def in_slices(a: Rows, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` entries, or one row."""
    n, at = len(a.first) - 1, 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(a.first, a.first[at] + most, "right")) - 1)
        yield at, min(stop, n)
        at = stop


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token of A, token of B, shared bytes: the product of the token-byte matrix of A and B's transposed."""
    total = int(ends_a[-1]) if len(ends_a) else 0
    of_a = Rows(np.r_[0, ends_a], np.arange(total))
    of_byte = Rows(np.arange(total + 1), np.repeat(np.arange(len(ends_b)), np.diff(np.r_[0, ends_b])))
    for begin, end in in_slices(of_a):
        yield product(of_a, of_byte, begin, end, max(len(ends_b), 1))


def shared_group_links(group_a: np.ndarray, group_b: np.ndarray, n_groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token of A, token of B, 1 for tokens of one group: the product of the token-group matrix of A and B's transposed, slice by slice."""
    of_a = Rows(np.arange(len(group_a) + 1), group_a)
    of_group = Rows(np.searchsorted(group_b, np.arange(n_groups + 1)), np.arange(len(group_b)))
    sizes = Rows(np.r_[0, np.cumsum((of_group.first[1:] - of_group.first[:-1])[group_a])] if len(group_a) else np.zeros(1, np.int64), group_a)
    for begin, end in in_slices(sizes):
        yield product(of_a, of_group, begin, end, max(len(group_b), 1))


class Digits:
    """Decimal texts of ids, with a sign after each."""

    def __init__(self, n: int) -> None:
        texts = [str(i).encode() for i in range(n)]
        width = max(map(len, texts)) + 1
        self.table = np.zeros((n, width), np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        for i, t in enumerate(texts):
            self.table[i, : len(t)] = np.frombuffer(t, np.uint8)

    def written(self, ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after another, each followed by its sign (0: none); and where each ends."""
        out = self.table[ids]
        out[np.arange(len(ids)), self.lengths[ids]] = signs
        keep = out > 0
        return out[keep], np.cumsum(keep.sum(1))


class Aligned:
    """Tokens of many texts side by side, of those that both tokenizers give back."""

    def __init__(self, a: Encoder, b: Encoder, column: pa.Array) -> None:
        data, offsets = led_by_space(column)
        parts = Parts(data, offsets, Rolling(BASES[0]))
        sides = [(e.side.vocabulary, *e.ids(parts)) for e in (a, b)]
        good = np.diff(offsets) > 0
        for vocabulary, ids, first in sides:
            reach = np.r_[0, np.cumsum(vocabulary.lengths[ids])][first]
            good &= np.diff(reach) == np.diff(offsets)
        while True:
            docs = np.flatnonzero(good)
            lengths = np.diff(offsets)[docs]
            self.bytes = np.r_[0, np.cumsum(lengths)]
            text = data[np.arange(int(lengths.sum())) + np.repeat(offsets[docs] - self.bytes[:-1], lengths)]
            kept = []
            for vocabulary, ids, first in sides:
                counts = np.diff(first)[docs]
                new = np.r_[0, np.cumsum(counts)]
                own = ids[np.arange(int(counts.sum())) + np.repeat(first[docs] - new[:-1], counts)]
                kept.append((own, new, np.cumsum(vocabulary.lengths[own])))
                wrong = vocabulary.joined(own) != text
                if wrong.any():
                    good[docs[np.unique(np.searchsorted(self.bytes, np.flatnonzero(wrong), "right") - 1)]] = False
            if good.sum() == len(docs):
                break
        self.docs = docs
        (self.a, self.first_a, self.ends_a), (self.b, self.first_b, self.ends_b) = kept

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and B that end together, from their overlaps."""
        parts = [(i[e], j[e]) for i, j, _ in overlap_links(self.ends_a, self.ends_b) for e in [self.ends_a[i] == self.ends_b[j]]]
        return tuple(np.concatenate(p) if parts else np.zeros(0, np.int64) for p in (zip(*parts) if parts else ((), ())))

    def groups(self, link_a: np.ndarray, link_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of A and of B: groups end at links, which stand in order on both sides."""
        return tuple(np.repeat(np.arange(len(link)), np.diff(np.r_[-1, link])) for link in (link_a, link_b))

    def written(self, digits: Digits, group_a: np.ndarray, group_b: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        n_a, n_b = (np.bincount(g, minlength=1) for g in (group_a, group_b))
        at_a = np.arange(len(self.a)) + (np.cumsum(n_b) - n_b)[group_a]  # behind B's tokens of the groups before
        at_b = np.arange(len(self.b)) + np.cumsum(n_a)[group_b]  # behind A's tokens of the groups up to its own
        ids, signs = np.empty(len(at_a) + len(at_b), np.int64), np.full(len(at_a) + len(at_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        signs[at_a[np.cumsum(n_a)[n_a > 0] - 1]] = ord("|")
        signs[at_b[np.cumsum(n_b)[n_b > 0] - 1]] = ord(";")
        doc_ends = (self.first_a + self.first_b)[1:]
        signs[doc_ends[doc_ends > 0] - 1] = 0
        data, reach = digits.written(ids, signs)
        cuts = np.r_[0, reach][np.r_[0, doc_ends]].tolist()
        raw = data.tobytes()
        return [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:])]


ENCODED = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
     ("links", pa.binary()), ("pairs", pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())])))]
)
ENCODED_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<struct<pair:long,n:long>>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Block:
    """Documents of one block, and the keys of their links."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, column: pa.Array, a: Encoder, b: Encoder, digits: Digits) -> None:
        found = Aligned(a, b, column)
        link_a, link_b = found.links()
        group_a, group_b = found.groups(link_a, link_b)
        texts = found.written(digits, group_a, group_b)
        per_doc = np.searchsorted(link_a, found.first_a)
        groups = np.r_[group_a, 0][found.first_a[:-1]] if len(found.docs) else []
        n_groups = np.diff(np.r_[groups, group_a[-1] + 1 if len(group_a) else 0])
        of = {int(d): k for k, d in enumerate(found.docs)}
        for k, doc in enumerate(ids):
            if (at := of.get(k)) is None:
                self.rows.append((doc, 0, 0, 0, 0, ""))
            else:
                n_a, n_b = (int(f[at + 1] - f[at]) for f in (found.first_a, found.first_b))
                self.rows.append((doc, n_a, n_b, int(n_groups[at]), int(per_doc[at + 1] - per_doc[at]), hashlib.sha256(texts[at]).hexdigest()))
        self.keys.append(found.a[link_a] * PAIR_BASE + found.b[link_b])
        self.size += int(found.bytes[-1])

    def table(self, block: int) -> pa.RecordBatch:
        keys, places, counts = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        raw = places.astype("<u4").tobytes()
        cuts = (4 * np.r_[0, np.cumsum([r[4] for r in self.rows])]).tolist()
        columns = [list(c) + [None] for c in zip(*self.rows)]
        links = [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:])] + [None]
        pairs = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["pair", "n"])
        n = len(self.rows)
        of_rows = pa.ListArray.from_arrays(pa.array([None] * n + [0, len(keys)], pa.int32()), pairs)
        arrays = [pa.array([block] * (n + 1), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(ENCODED)[1:])), pa.array(links, pa.binary()), of_rows]
        return pa.RecordBatch.from_arrays(arrays, schema=ENCODED)


def align_tokenizers(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4 << 20,
    salts: int = 8,
) -> DataFrame:
    """One row per document: tokens of both sides, groups, links, ``n_best`` links whose id pair is the most frequent
    one of its id of B, ``count_sum`` of the corpus-wide counts over its links, and the digest of its groups."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Encoder(ByteLevel, path_a), Encoder(Pieces, path_b)
        digits = Digits(max(len(e.side.vocabulary.lengths) for e in (a, b)))
        number, block = TaskContext.get().partitionId() << BLOCK_BITS, Block()
        for batch in bounded(batches, 1):
            block.add(batch.column(0).to_pylist(), batch.column(1), a, b, digits)
            if block.size >= block_bytes:
                yield block.table(number)
                number, block = number + 1, Block()
        if block.rows:
            yield block.table(number)
        release_memory()

    encoded = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(encode, ENCODED_DDL), "aligned")
    sent = encoded.where("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("at", "p")).select("block", "at", "p.pair", "p.n")
    totals = materialize(sent.groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals")
    of_b = F.pmod("pair", F.lit(PAIR_BASE)).alias("b")
    highest = totals.groupBy(of_b).agg(F.max("total").alias("highest"))
    judged = totals.select("pair", "total", of_b).join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    salted = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = sent.select("block", "at", "pair", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    answers = asked.join(salted, ["pair", "salt"]).select(F.col("block").alias("asking"), "at", "total", "best")

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("at").to_numpy())
        total, best = found.column("total").to_numpy()[order], found.column("best").to_numpy()[order]
        links = [np.frombuffer(x, "<u4") for x in rows.column("links").to_pylist()]
        sums, bests = ([int(of[x].sum()) for x in links] for of in (total, best))
        columns = {c: rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({c.split()[0]: columns[c.split()[0]] for c in RESULT.split(", ")})

    of_docs = encoded.where("pairs IS NULL").drop("pairs")
    n_blocks = encoded.where("pairs IS NOT NULL").count()
    sides = of_docs.repartition(max(n_blocks, 1), "block"), answers.repartition(max(n_blocks, 1), "asking")  # tasks grow in number with the blocks
    return sides[0].groupBy("block").cogroup(sides[1].groupBy("asking")).applyInArrow(finish, RESULT)


def token_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", group_links: bool = False) -> DataFrame:
    """The links themselves, one row each: ``doc_id, a_place, b_place, a_id, b_id, n_bytes, together``.

    Overlap links say how many bytes both tokens share and whether they end together; with ``group_links``,
    rows are the links of all tokens of one group, ``n_bytes`` null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Encoder(ByteLevel, path_a), Encoder(Pieces, path_b)
        for batch in bounded(batches, 1):
            ids, found = batch.column(0), Aligned(a, b, batch.column(1))
            parts = overlap_links(found.ends_a, found.ends_b)
            if group_links:
                group_a, group_b = found.groups(*found.links())
                parts = shared_group_links(group_a, group_b, int(group_a[-1]) + 1 if len(group_a) else 0)
            for i, j, shared in parts:
                doc = np.searchsorted(found.first_a, i, "right") - 1
                numbers = [i - found.first_a[doc], j - found.first_b[doc], found.a[i], found.b[j]]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(found.docs[doc])), *(pa.array(x, pa.int64()) for x in numbers),
                     pa.nulls(len(i), pa.int64()) if group_links else pa.array(shared, pa.int64()), pa.array(found.ends_a[i] == found.ends_b[j])],
                    ["doc_id", "a_place", "b_place", "a_id", "b_id", "n_bytes", "together"],
                )

    schema = "doc_id long, a_place long, b_place long, a_id long, b_id long, n_bytes long, together boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(work, schema)
