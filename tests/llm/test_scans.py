"""Language, quality, packing, licenses and decontamination on edge cases and small tables."""

import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirework.llm import license_rules
from quirework.llm.decontaminate import drop_leaks, find_leaks
from quirework.llm.language_id import identify_languages
from quirework.llm.licenses import Scanner, resolve, scan_licenses
from quirework.llm.packing import SECOND, Packer, WordTokens, pack_documents
from quirework.llm.quality import STATISTICS, learn_rules, score_quality, tree_paths

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet")


def test_languages(spark, larger):
    found = identify_languages(larger).join(larger.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]).all()
    assert (found.lang == found.lang_pred)[found.held_out].mean() > 0.98
    assert found.score.between(0, 1).all()


def test_language_edges(spark, larger, edge_docs, edge_rows, no_docs):
    none = identify_languages(edge_docs).collect()  # no row has a language
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(edge_rows)
    both = larger.select("doc_id", "text", "lang").union(edge_docs.select(F.col("doc_id") + 10_000, "text", "lang"))
    found = {r.doc_id - 10_000: r for r in identify_languages(both).collect() if r.doc_id >= 10_000}
    for doc, text in edge_rows:
        assert (found[doc].lang_pred == "und") == (not any(map(str.isalpha, text or "")))
    assert identify_languages(no_docs).count() == 0


def test_languages_do_not_read_the_held_out_rows(larger):
    """Wrong labels on held-out rows change nothing."""
    wrong = F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang"))
    one, two = (sorted(map(tuple, identify_languages(d).collect())) for d in (larger, larger.withColumn("lang", wrong)))
    assert one == two


def code_length(text, sample, order=3):
    """Bits of a text after the byte strings of a sample, byte by byte; nothing is left out of the sample."""
    after = {}
    for data in map(str.encode, sample):
        for i in range(len(data)):
            for k in range(min(order, i) + 1):
                after.setdefault(data[i - k : i], Counter())[data[i]] += 1
    bits, data = 0.0, text.encode()
    for i, byte in enumerate(data):
        for k in range(min(order, i), -1, -1):
            seen = after.get(data[i - k : i])
            if seen:
                scale = sum(seen.values()) + len(seen)
                bits += np.log2(scale / (seen[byte] or len(seen)))
                if seen[byte]:
                    break
        else:
            bits += 8
    return bits


def test_every_context_of_the_sample_counts(spark):
    """Languages of many characters and a rare one among them, against the plain version."""
    rng = random.Random(8)
    scripts = {"big1": (0x4E00, 900, 60), "big2": (0xAC00, 900, 60), "big3": (0x61, 26, 60), "rare": (0x4E00, 300, 3)}
    rows = []
    for lang, (low, wide, n) in scripts.items():
        rows += [("".join(chr(low + int(wide * rng.random() ** 2)) + " " * (rng.random() < 0.2) for _ in range(150)), lang) for _ in range(n * 4 // 3)]
    rows = [(i, text, lang) for i, (text, lang) in enumerate(rows)]
    sample = {lang: [t for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 4 != 2] for lang in sorted(scripts)}
    found = {r.doc_id: r for r in identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    for doc, text in held[::6] + held[-3:]:
        bits = {lang: code_length(text, own) for lang, own in sample.items()}
        assert found[doc].lang_pred == min(bits, key=bits.get)
        assert abs(found[doc].bits_per_byte - min(bits.values()) / len(text.encode())) < 1e-6


def test_quality(spark, larger):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    found = score_quality(larger, labels).join(labels, "doc_id").toPandas()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in found.doc_id]).all()
    assert (found.quality == found.predicted)[found.held_out].mean() > 0.95
    assert ((found.score >= 0.3) == (found.predicted == 1)).all() and found.score.between(0, 1).all()


def test_quality_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(edge_rows[0][0], 1), (edge_rows[0][0], 1), (None, 0), (5, None)], "doc_id long, quality int")
    found = score_quality(edge_docs, labels)
    assert found.columns == edge_docs.columns[:5] + ["score", "run", "stat_words", "component_id", "held_out", "predicted"]
    assert found.count() == len(edge_rows) and found.where("score is null or score < 0 or score > 1").count() == 0
    none = score_quality(no_docs, labels)
    assert none.count() == 0
    half = score_quality(edge_docs, labels.where("false")).select("score").distinct().collect()
    assert [round(r.score, 6) for r in half] == [0.5]


def plain_statistics(text):
    """Every statistic of one text, counted one by one."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    kinds = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "high": bytes(range(128, 256)), "space": bytes([9, 10, 11, 12, 13, 32])}
    kinds["other"] = bytes(set(range(256)) - set(b"".join(kinds.values())))
    share = lambda kind: sum(b in kind for b in data) / max(1, len(data))
    per_word = lambda values: sum(values) / max(1, len(words))
    pairs = list(zip(words, words[1:]))
    return [
        len(data), len(words), data.count(b"\n") + 1, per_word(map(len, words)), per_word(len(w) > 20 for w in words),
        *(share(kinds[k]) for k in ("upper", "lower", "digit", "other", "high", "space")),
        per_word(w[-1] in kinds["other"] and w[-1] not in b".?," for w in words), share(b"|"), share(b"!"), share(b".?"),
        len(set(words)) / max(1, len(words)), len(set(pairs)) / max(1, len(pairs)), per_word(a == b for a, b in pairs),
        len(words) / max(1, sum(b in b".?" for b in data)),
    ]


def test_quality_scores_equal_the_rules_row_by_row(spark, larger, edge_docs, edge_rows):
    """Statistics counted in plain Python, rules read one after another, weights added up; repeated rows get the same score."""
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rules, intercept = learn_rules(larger, labels, "doc_id", "text", "quality", 5, 0, 20_000, 12, 3, 0.0002, 7)
    assert len(rules) > 1
    repeated = edge_docs.select(F.col("doc_id") + 50_000, "text").union(edge_docs.select(F.col("doc_id") + 50_000, "text"))
    docs = larger.select("doc_id", "text").union(repeated)
    found = score_quality(docs, labels, penalty=0.0002).select("doc_id", "text", "score").collect()
    assert len(found) == larger.count() + 2 * len(edge_rows)
    test = {"<=": lambda a, b: a <= b, ">": lambda a, b: a > b}
    for r in found[::7] + [r for r in found if r.doc_id >= 50_000]:
        facts = dict(zip(STATISTICS, plain_statistics(r.text)))
        holds = lambda rule: all(test[op](facts[name], float(limit[:-1])) for name, op, limit in (part.split() for part in rule.split(" AND ")))  # noqa: E731, B023
        total = intercept + sum(weight for rule, weight in rules if holds(rule))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9, (r.doc_id, facts)


def test_tree_paths():
    text = "Tree 0\n    If (feature 0 <= 3.5)\n     If (feature 1 <= 1.0)\n      Predict: 0\n     Else (feature 1 > 1.0)\n      Predict: 1\n    Else (feature 0 > 3.5)\n     Predict: 1\n"
    assert tree_paths(text) == ["bytes <= 3.5D", "bytes <= 3.5D AND words <= 1.0D", "bytes <= 3.5D AND words > 1.0D", "bytes > 3.5D"]


def check_packing(pieces, rows, size=4096):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = pieces.sort_values("start").groupby("doc_id")
    assert set(by_doc.groups) == {d for d, _ in rows}
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in by_doc.get_group(doc).itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        total = own.length.sum()
        assert total == size or (total < size and total & (total - 1) == 0)


def test_packing(spark, edge_docs, edge_rows, no_docs):
    check_packing(pack_documents(edge_docs, PATH).toPandas(), edge_rows)
    check_packing(pack_documents(edge_docs.coalesce(1), PATH, size=64, max_open=3).toPandas(), edge_rows, 64)
    check_packing(pack_documents(edge_docs, PATH, size=64, max_open=2, second_windows=3).toPandas(), edge_rows, 64)
    assert pack_documents(no_docs, PATH).count() == 0


def test_windows_come_from_the_rule_in_two_rounds(spark, larger):
    """Rests of documents fill windows by sum of squares in two rounds; the smaller part is left to be cut anew, and none is padded."""
    pieces = pack_documents(larger.repartition(4, "doc_id"), PATH, size=64).toPandas()
    check_packing(pieces, [(r.doc_id, r.text) for r in larger.select("doc_id", "text").collect()], 64)
    rests = pieces[pieces.start >= pieces.doc_tokens // 64 * 64]
    cut_anew = rests[(rests.start % 64 != 0) | (rests.start + rests.length != rests.doc_tokens)].sequence_id.nunique()
    assert cut_anew < 0.5 * rests.sequence_id.nunique() and (pieces.sequence_id >= (SECOND << 40)).any()


SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZI09é日İşΣ" + SIGNS + "“”‘’…—«»€。≠·" + chr(0x301) + chr(0x307) + " \n\t\u0085\u00a0\u3000"), max_size=24), min_size=1, max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    tokens, plain = WordTokens(PATH), Tokenizer.from_file(PATH)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(tokens.ids(pa.array(texts))) == want


@pytest.mark.parametrize("text", ["He said “yes”.", "the dogs'.", "so…!", "well—.", "no»,", "5€.", "終。.", "a≠.", "İ İ.", "it's, isn't.", "<|endoftext|>.", "a.b. (c)!"])
def test_signs_at_the_end_of_words(text):
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert list(WordTokens(PATH).ids(pa.array([text]))) == [np.array(ids, "<u4").tobytes()]


def test_best_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    packer = Packer(16, 1000, 0)
    for n in rng.integers(1, 16, 400).tolist():
        packer.levels[1:16] = rng.integers(0, 4, 15)

        def after(h):
            left = packer.levels.copy()
            left[h] -= h > 0
            left[h + n] += 1
            return (left[1:16].astype(int) ** 2).sum()

        options = [0] + [h for h in range(1, 17 - n) if packer.levels[h]]
        least = min(after(h) for h in options)
        assert packer.best_level(n) == max(h for h in options if after(h) == least)


def test_licenses(edge_docs, edge_rows, no_docs):
    found = {r.doc_id: r for r in scan_licenses(edge_docs).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for doc, text in edge_rows:
        words = word.findall(brute.lower(text))
        base = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        r, places = found[doc], [i for i, _ in base]
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert any("gpl-3" in r.labels.split(",") and "mit" in r.labels.split(",") for r in found.values())
    assert scan_licenses(no_docs).count() == 0


def test_every_rule_is_gated_by_a_keyword_it_needs():
    for label, weight, keyword, regex in license_rules.rules():
        assert 0 < weight <= 1 and keyword == keyword.lower() and re.compile(regex)
    assert len(license_rules.rules()) > 300


def generated(nodes, rng):
    """A string that a parsed regex matches, look-around left out."""
    out = ""
    for kind, value in nodes:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "SUBPATTERN":
            out += generated(value[-1], rng)
        elif kind == "BRANCH":
            out += generated(rng.choice(value[1]), rng)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            out += "".join(generated(inner, rng) for _ in range(rng.randint(least, min(most, least + 2))))
        elif kind == "IN":
            sort, chosen = rng.choice(value)
            out += {"LITERAL": lambda: chr(chosen), "RANGE": lambda: chr(rng.randint(*chosen)), "CATEGORY": lambda: rng.choice(" \n" if "SPACE" in str(chosen) else "07")}[str(sort)]()
        else:
            assert kind in ("ASSERT", "ASSERT_NOT"), kind
    return out


def test_gated_rules_find_what_ungated_ones_do():
    rules, rng = license_rules.rules(), random.Random(2)
    scanner = Scanner(rules)
    for priority, (_, _, _, regex) in enumerate(rules):
        for _ in range(30):
            text = generated(re._parser.parse(regex), rng)
            ungated = {(*m.span(), priority) for m in re.finditer(regex, text)}
            assert ungated and ungated <= set(scanner.rule_matches(text)), text
    row = lambda text: [s["label"] for s in scanner.row(text)[-1]]
    assert row("licensed under a creative commons attribution-non-commercial license") == ["cc-by-nc"]
    assert row("expat license") == ["mit"]


@pytest.mark.parametrize(
    "text, labels",
    [
        ("apache license 2.0", "apache-2"),
        ("the apache 2.4 server", ""),
        ("licensed under the Apache License, Version 2.0", "apache-2"),
        ("licensed under cc by-sa 4.0", "cc-by,cc-by-sa"),
        ("CC-BY-NC-ND-4.0", "cc-by,cc-by-nc-nd"),
        ("gplv3", "gpl-3"),
        ("a bare gpl-3.0 note", "gpl-3"),
        ("GNU GPL v2+ or LGPL 2.1", "gpl-2,lgpl"),
        ("the GNU General Public License 2", "gpl,gpl-2"),
        ("MPL 2.0 and EPL-1.0", "epl,mpl-2"),
        ("BSD 3-clause", "bsd-3"),
        ("MIT-licensed", "mit"),
        ("https://spdx.org/licenses/GPL-2.0-only", "gpl-2"),
        ("See https://opensource.org/license/mit", "mit"),
        ("you may not use this file except in compliance with the License", "apache-2"),
        ("accept by mail, complaints by post", ""),
    ],
)
def test_names_short_names_notices_and_links(text, labels):
    assert Scanner(license_rules.rules()).row(brute.lower(text))[4] == labels


def test_resolve():
    assert resolve([(0, 10, 5), (2, 8, 7)], 9) == [(0, 10, 5)]  # inside one of higher priority
    assert resolve([(0, 10, 5), (2, 8, 1)], 9) == [(0, 10, 5), (2, 8, 1)]  # inside one of lower priority
    assert resolve([(0, 5, 3), (0, 5, 2), (4, 9, 1)], 9) == [(0, 5, 2), (4, 9, 1)]
    scanner = Scanner(license_rules.rules())
    spans = scanner.row("released under the gnu general public license version 3")[-1]
    assert [s["label"] for s in spans] == ["gpl-3"]


def leaks(docs, items, overlap=0.8):
    """Every passage of two strides against every item, by five-word shingles of both parts; the width is the item's own."""
    from quirework.llm.decontaminate import parts

    words = lambda text: re.findall(r"[0-9a-z\x80-\U0010ffff]+", brute.lower(text))
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    split = {i: [words(p) for p in parts(t)] for i, t in items if t is not None}
    out = set()
    for doc, text in docs:
        w = words(text)
        for item, sides in split.items():
            if any(sides):
                width = max(128, 2 << (sum(map(len, sides)) - 1).bit_length())
                for at in range(0, max(1, len(w)), width // 2):
                    passage = w[at : at + width]
                    shares = [len(grams(s, min(5, len(s))) & grams(passage, min(5, len(s)))) / len(grams(s, min(5, len(s)))) for s in sides if s]
                    if min(shares) >= overlap:
                        out.add((doc, item))
    return out


def test_leaks(spark, edge_docs, edge_rows, no_docs):
    rng = np.random.default_rng(4)
    texts = [t for _, t in edge_rows if t and len(t.split()) > 30]
    prose = [" ".join(t.split()[5:35]) for t in texts]
    cut = [" ".join(w for w in p.split() if rng.random() > 0.06) for p in prose]
    items = list(enumerate(prose + cut + ["one", "two words", "What is it? A b c", "", "?", "Line A line b line C line"])) + [(900, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = leaks(edge_rows, items)
    found = {(r.doc_id, r.item_id) for r in find_leaks(edge_docs, benchmark).collect()}
    assert found == expected and len(found) > 20
    small = find_leaks(edge_docs, benchmark, shard=3, portion_bytes=5000, block=2)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == expected
    left = drop_leaks(edge_docs, benchmark)
    assert left.columns == edge_docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in edge_rows} - {d for d, _ in expected}
    assert find_leaks(no_docs, benchmark).count() == 0
    assert find_leaks(edge_docs, benchmark.where("false")).count() == 0
    assert drop_leaks(edge_docs, benchmark.where("false")).count() == len(edge_rows)


def test_an_item_depends_on_no_other(spark):
    """Question and answer 200 words apart: clean, whatever else the benchmark holds; and nothing else changes either."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    item = "What does " + " ".join(word() for _ in range(9)) + "? It " + " ".join(word() for _ in range(8))
    head, tail = item.split("? ")
    apart = f"{head} " + " ".join(word() for _ in range(200)) + f" {tail}"
    long_item = " ".join(word() for _ in range(600))
    docs = spark.createDataFrame([(1, apart), (2, item), (3, long_item + " " + apart), (4, "x " * 700 + long_item)], "doc_id long, text string")
    pairs = lambda *items: {(r.doc_id, r.item_id) for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert pairs((7, item)) == {(2, 7)}
    assert pairs((7, item), (8, long_item)) == {(2, 7), (3, 8), (4, 8)}
    assert pairs((7, item), (8, long_item), (9, head), *((100 + i, " ".join(word() for _ in range(5 * i + 1))) for i in range(40))) >= {(2, 7), (3, 8), (4, 8)}


def test_leaks_of_the_small_tables(spark):
    docs, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = Counter((r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect())
    assert set(pairs) == leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert set(pairs.values()) == {1}


def test_the_word_store_stays_small_beside_other_stages():
    """pipeline: each worker kept its words as Python objects, over 100 bytes a word, while later stages ran."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words = WordTokens(path, max_parts=3000)
    texts = [" ".join(f"w{k * 7919 % 9973}x{k % 11}" for k in range(i, i + 400)) for i in range(0, 4000, 300)]
    for text in [None, "", *texts, texts[0]]:
        plain = words.tokenizer.encode((text or "").lower(), add_special_tokens=False).ids
        assert list(words.ids(pa.array([text]))) == [np.array(plain, "<u4").tobytes()]
    assert 0 < len(words.known[0][0]) <= 3000 // 2 + 400
    assert sum(part.nbytes for part in words.known[0]) < 64 * len(words.known[0][0])
