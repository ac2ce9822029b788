"""Hard negatives, source mixing and tokenizer alignment against plain versions."""

import hashlib
import math
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirework.llm import alignment as A, hard_negatives as H
from quirework.llm.mixing import mix_sources, quality_weight, uniform
from quirework.llm.text_bytes import BASES, Rolling

SMALL = "/root/testdata/sf0.001"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<float>, label int, rank int, score double, window string"


# ---- hard negatives


def plain_negatives(rows, step=100, positives=5, negatives=10, low=30, high=90):
    part = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, [math.floor(256 * float(x)) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors = {(i, tuple(v), label) for i, v, label in part if i % step == 0}
    out = []
    for a, v, label in anchors:
        ranked = sorted(((-dot(v, w), i, other) for i, w, other in part if i != a))
        for score, p, _ in [r for r in ranked if r[2] == label][:positives]:
            fitting = [r for r in ranked if r[2] != label and low * -score <= 100 * -r[0] <= high * -score]
            out += [(a, p, k + 1, i, -score, -s) for k, (s, i, _) in enumerate(fitting[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, 1, 0.5, "w") for i, v, label in rows], VECTORS)
    found = H.mine_hard_negatives(table, lambda i: i % 100 == 0, **options)
    return sorted(map(tuple, found.collect()))


def vectors(n, seed, width=24, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(labels)]
    return [(7 * i, [float(np.float32(c + rng.gauss(0, 0.1))) for c in centres[k]], k) for i in range(n) for k in [rng.randrange(labels)]]


@pytest.mark.parametrize("blocks", [1, 5])
def test_negatives_equal_the_plain_version(spark, blocks):
    rows = vectors(700, 3)
    assert mined(spark, rows, least_blocks=blocks, least_rows=1) == plain_negatives(rows)


def test_many_anchor_blocks_give_the_same_rows(spark):
    rows = vectors(400, 4)
    assert mined(spark, rows, block_bytes=8 * 24 * 2, least_blocks=1) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    """Nulls, NaN, infinities, short and empty vectors, ties, repeated rows, equal vectors, negative and zero scores."""
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(rng.choice([0, 1, 3, 3, 3]))], rng.randrange(2)) for i in range(0, 1200, 20)]
    rows += [(100, [1.0, None], 0), (200, [math.nan], 1), (300, [math.inf, 1.0], 0), (400, None, 1), (None, [1.0], 0), (500, [1.0], None)]
    rows += rows[5:15] + [(i, [1.0, 1.0, 1.0], i % 2) for i in range(1, 60)] + [(600, [1.0, 1.0, 1.0], 1)] * 2
    assert mined(spark, rows, least_blocks=3, least_rows=1) == plain_negatives(rows)
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 0)]) == []


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="would not be exact"):
        mined(spark, [(100, [1e9], 0), (1, [1.0], 0)])


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 20), st.floats(-50, 400), st.integers(0, 999))
def test_the_index_loses_no_row(n, width, threshold, seed):
    rng = np.random.default_rng(seed)
    values, asked = (rng.integers(-9, 10, (k, width)).astype(float) for k in (n, 5))
    rows = H.Rows(values)
    anchors = H.Rows(asked, rows.order)
    least = min(max(threshold, 0) / max(x, 1e-9) for x in anchors.norms())
    found = {i: dict(zip(at.tolist(), s.tolist())) for i, at, s in H.SuffixIndex(rows, least).reached(anchors, np.full(5, threshold))}
    scores = asked @ values.T
    if threshold >= 0:
        assert found == {i: {j: s for j, s in enumerate(scores[i]) if s >= threshold} for i in range(5)}


def test_the_index_omits_covered_dimensions():
    rows = H.Rows(np.random.default_rng(1).normal(0, 10, (200, 32)).round())
    sizes = [sum(len(h) for h, _ in H.SuffixIndex(rows, t).postings) for t in (0, 20, 40, 1e6)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] == 200 * len(rows.cuts) > sizes[1] > sizes[2] and sizes[3] == 0


# ---- mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while open_ and left > 1e-9:
        unit, above = left / sum(weight[s] for s in open_), set()
        for s in open_:
            if target[s] + unit * weight[s] >= cap * sizes[s]:
                above.add(s)
        if not above:
            for s in open_:
                target[s] += unit * weight[s]
            break
        for s in above:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= above
    return target


def checked_mix(found, rows):
    words = lambda t: len(brute.SPACE_WORDS.findall(t or ""))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    target, taken = plain_targets(sizes), Counter()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in found) == sorted((d is None, d or 0, words(t)) for d, t, _ in rows)
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-5
        assert 0 <= r.taken <= 3 * r.size and r.size * r.epochs <= r.taken <= r.size * (r.epochs + 1)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
        own = sorted((r for r in found if r.source == s and r.size), key=lambda r: (r.draw, r.doc_id or 0, -r.taken))  # repeated rows tie
        drawn = [(r.taken - r.epochs * r.size) / r.size for r in own]
        assert drawn == sorted(drawn, reverse=True) and sum(0 < d < 1 for d in drawn) <= 1  # in order of their keys, one cut


def mix_rows(n, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "B", "ä", "zz", "日本"]
    rows = [(i if i % 11 else None, " ".join(["w"] * rng.choice([0, 1, 5, 40, 400])) if i % 7 else None, names[min(int(rng.expovariate(0.5)), 7)]) for i in range(n)]
    return rows + rows[:9]


@pytest.mark.parametrize("n", [3, 40, 400])
def test_mix_meets_its_targets(spark, n):
    rows = mix_rows(n, n)
    table = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], "doc_id long, text string, source string, size int, range_no int, target double")
    found = mix_sources(table.repartition(5))
    checked_mix(found.collect(), rows)
    again = mix_sources(table.repartition(3))
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, again.collect()))


def test_mix_of_empty_tables_and_one_hot_source(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, None, "a"), (2, "", None)], [(i, "one two", "hot") for i in range(500)] + [(500, "x", "cold")]):
        checked_mix(mix_sources(spark.createDataFrame(rows, schema)).collect(), rows)


def test_better_documents_are_drawn_first(spark):
    """With three times the weight, the first draw is the document's in three of four cases."""
    rows = spark.range(20_000).select(F.col("id").alias("pair"), F.explode(F.array(F.lit(1.0), F.lit(3.0))).alias("w"))
    keyed = rows.select("pair", "w", (-F.ln(uniform(F.col("pair"), F.col("w"))) / F.col("w")).alias("draw"))
    share = keyed.groupBy("pair").agg(F.min_by("w", "draw").alias("first")).agg(F.avg((F.col("first") == 3).cast("int"))).first()[0]
    assert abs(share - 0.75) < 0.01


def test_quality_weight_ranks_prose_above_numbers(evaluate):
    prose, mixed, numbers, empty = evaluate(quality_weight(F.col("x")), ["plain words", "a1 b2, c3", "1,234;5678", ""])
    assert 1 == prose == empty > mixed > numbers > 0


# ---- alignment


def plain_alignment(rows):
    tokenizer = Tokenizer.from_file(PATH_A)
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    of_id = {i: s for s, i in tokenizer.get_vocab().items()}
    found, counts = [], Counter()
    for doc, text in rows:
        a, b = [], []
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            raw = [[A.byte_level_bytes(of_id[i]) for i in a], [A.piece_bytes(pieces.id_to_piece(i)) for i in b]]
            if any(b"".join(r) != (" " + text).encode() for r in raw):
                a, b = [], []
        ends = [list(np.cumsum([len(x) for x in r])) for r in raw] if a else [[], []]
        at_b = {e: j for j, e in enumerate(ends[1])}
        links = [(i, at_b[e]) for i, e in enumerate(ends[0]) if e in at_b]
        groups, x, y = [], 0, 0
        for i, j in links:
            groups.append((a[x : i + 1], b[y : j + 1]))
            x, y = i + 1, j + 1
        counts.update((a[i], b[j]) for i, j in links)
        found.append((doc, a, b, groups, [(a[i], b[j]) for i, j in links]))
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(highest.get(j, 0), n)
    out = []
    for doc, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=lambda r: (r[0] is None, r))


ODD = [
    "a  b\n\n\tc ", " lead", "  two", "tail  ", " nbsp   x", "x 　 y　z", "x  y", "a\u0085 b", "▁ mark", "a ▁b", "<s> </s> <unk> <|endoftext|> <0x41>",
    "don't 'S we'RE I'll", "12 345,6", "naïve café" + chr(0x301), "é" * 300, "日本語 テスト", "\x00 nul", "🙂 🙃🙂", "ﬁ Å", "«quoted» “text”", "a​b c​ d", "x" * 3000, " ", "\n",
]


def aligned(docs, **options):
    rows = A.align_tokenizers(docs, PATH_A, PATH_B, **options).collect()
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in order) for r in rows), key=lambda r: (r[0] is None, r))


def test_alignment_equals_the_plain_version(spark, edge_rows, edge_docs):
    rows = edge_rows + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = edge_docs.select("doc_id", "text", "n_chars").union(spark.createDataFrame([(d, t, 1) for d, t in rows[len(edge_rows) :]], "doc_id long, text string, n_chars long"))
    want = plain_alignment(rows)
    assert sum(r[1] > 0 for r in want) > 30 and sum(r[1] == 0 for r in want) >= 4
    assert aligned(docs) == want
    assert aligned(docs.repartition(3), block_bytes=64) == want


def test_alignment_of_repeated_and_no_rows(spark, repeated_docs, no_docs):
    assert aligned(repeated_docs) == plain_alignment([tuple(r) for r in repeated_docs.collect()])
    assert A.align_tokenizers(no_docs, PATH_A, PATH_B).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'Zs1.,!-_ \n\t\r\u0085  　▁é日“«́🙂<|>"), max_size=30), min_size=1, max_size=4))
def test_parts_give_the_ids_of_whole_texts(texts):
    data, offsets = A.led_by_space(pa.array(texts))
    parts = A.Parts(data, offsets, Rolling(BASES[0]))
    whole = Tokenizer.from_file(PATH_A)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    for kind, path, plain in (
        (A.ByteLevel, PATH_A, lambda t: whole.encode(" " + t, add_special_tokens=False).ids),
        (A.Pieces, PATH_B, pieces.encode),
    ):
        ids, first = A.Encoder(kind, path).ids(parts)
        for k, text in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == (plain(text) if text else [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.data())
def test_products_equal_dense_ones(lengths, data):
    """The overlap product and the group product against matrices with all entries."""
    total = sum(lengths)
    cuts = sorted(data.draw(st.sets(st.integers(1, total), max_size=total)) | {total})
    ends = [np.cumsum(lengths), np.array(cuts)]
    bytes_of = [(np.searchsorted(e, np.arange(total), "right")[None, :] == np.arange(len(e))[:, None]).astype(int) for e in ends]
    overlaps = np.zeros((len(ends[0]), len(ends[1])), int)
    for i, j, n in A.overlap_links(*ends):
        overlaps[i, j] += n
    assert (overlaps == bytes_of[0] @ bytes_of[1].T).all()
    shared = np.intersect1d(*ends)
    group_a, group_b = (np.searchsorted(shared, e) for e in ends)  # both end at the last byte
    links = np.zeros_like(overlaps)
    for i, j, n in A.shared_group_links(group_a, group_b, len(shared)):
        links[i, j] += n
    assert (links == (group_a[:, None] == group_b[None, :])).all()


@given(st.lists(st.integers(0, 9), max_size=30), st.integers(1, 30))
def test_slices_hold_all_rows(lengths, most):
    rows = A.Rows(np.r_[0, np.cumsum(lengths, dtype=np.int64)], np.arange(sum(lengths)))
    slices = list(A.in_slices(rows, most))
    assert [i for x, y in slices for i in range(x, y)] == list(range(len(lengths)))
    assert all(y == x + 1 or sum(lengths[x:y]) <= most for x, y in slices)


def test_links_of_a_text(spark):
    docs = spark.createDataFrame([(1, "unbelievable tokens"), (2, None)], "doc_id long, text string")
    links = A.token_links(docs, PATH_A, PATH_B).toPandas()
    assert links.n_bytes.sum() == len(" unbelievable tokens") and set(links.doc_id) == {1}
    together = plain_alignment([(1, "unbelievable tokens")])[0][4]
    assert links.together.sum() == together
    of_groups = A.token_links(docs, PATH_A, PATH_B, group_links=True).toPandas()
    assert of_groups.together.sum() == together and len(of_groups) >= len(links)


def test_words_of_thue_and_morse_are_told_apart():
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + two).encode(), np.uint8)
    for base in BASES:
        a, b = Rolling(base).spans(data, np.array([0, 1024]), np.array([1024, 2048])).tolist()
        assert a != b
