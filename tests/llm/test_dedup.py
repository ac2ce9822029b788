"""Exact, line, passage, substring and near deduplication against plain versions."""

from collections import defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quirework.llm.exact_dedup import exact_dedup
from quirework.llm.line_dedup import line_dedup, line_dedup_digest
from quirework.llm import near_dedup as near_module
from quirework.llm.near_dedup import band_keys, near_dedup, signatures
from quirework.llm.passage_dedup import dedup_passages
from quirework.llm.suffix_dedup import dedup_substrings, sliding_min
from quirework.llm.text_bytes import BASES, Rolling, mix


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_exact_dedup(edge_docs, edge_rows, keep, best):
    groups = defaultdict(list)
    for doc, text in edge_rows:
        groups[brute.lower(text)].append(doc)
    expected = sorted((d, best(groups[brute.lower(t)]), len(groups[brute.lower(t)]), d == best(groups[brute.lower(t)]), brute.sha(brute.lower(t))) for d, t in edge_rows)
    assert rows(exact_dedup(edge_docs, keep=keep, runs=8, fan_in=2), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected


def test_exact_dedup_repeated_rows(repeated_docs):
    found = exact_dedup(repeated_docs).collect()
    kept = {(r.doc_id, r.kept) for r in found if r.group_size == 4}
    assert kept == {(4, False), (9, True), (None, False)}
    assert {(r.doc_id, r.kept) for r in found if r.group_size == 2} == {(None, False), (11, True)}


def test_exact_dedup_sorts_nothing_that_is_not_read(edge_docs):
    assert "Sort [" not in exact_dedup(edge_docs)._jdf.queryExecution().optimizedPlan().toString()


def test_line_dedup(edge_docs, edge_rows):
    seen, expected = set(), []
    for doc, text in sorted(edge_rows):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            gone.update(range(i, i + 3) if window in seen else ())
            seen.add(window)
        spans = sum(1 for i in gone if i - 1 not in gone)
        expected.append((doc, len(lines), len(gone), spans, brute.sha("\n".join(x for i, x in enumerate(lines) if i not in gone))))
    assert rows(line_dedup_digest(edge_docs), "doc_id", "n_lines", "n_removed", "n_spans", "kept_sha256") == sorted(expected)


def test_line_dedup_repeated_rows(spark):
    text = "a\nb\nc"
    docs = spark.createDataFrame([(1, text), (1, text), (1, "x\n" + text), (2, text)], "doc_id long, text string")
    found = rows(line_dedup(docs), "doc_id", "n_lines", "n_removed")
    assert found == [(1, 3, 0), (1, 3, 0), (1, 4, 3), (2, 3, 3)]


def test_passages(edge_docs, edge_rows):
    found = dedup_passages(edge_docs, block_bytes=4000, bucket_bytes=30_000)
    assert rows(found.withColumn("sha", F.sha2("text", 256)), "doc_id", "n_words", "n_removed", "sha") == brute.passages(edge_rows)


def test_passages_of_repeated_rows(repeated_docs):
    found = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in dedup_passages(repeated_docs).collect())
    assert found == [(4, 80, 0), (4, 80, 0), (9, 80, 80), (11, 0, 0), (99, 0, 0), (99, 80, 80)]


def test_substrings(edge_docs, edge_rows):
    found = dedup_substrings(edge_docs, block_bytes=4000, bucket_bytes=30_000)
    expected = brute.substrings(edge_rows)
    assert rows(found.withColumn("sha", F.sha2("kept", 256)), "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == expected


def test_substrings_of_repeated_rows(repeated_docs):
    assert {(r.n_bytes, r.n_removed) for r in dedup_substrings(repeated_docs).collect()} == {(309, 309), (0, 0)}


def test_near(edge_docs, edge_rows):
    for shingle in (2, 5):
        assert rows(near_dedup(edge_docs, shingle=shingle), "doc_id", "n_shingles", "component_id", "kept") == brute.near(edge_rows, shingle)


def test_near_repeated_rows(repeated_docs):
    found = near_dedup(repeated_docs).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(4, 4, True), (9, 4, False), (None, None, False), (11, 11, True)} or {
        (r.doc_id, r.component_id, r.kept) for r in found if r.doc_id
    } == {(4, 4, True), (9, 4, False), (11, 11, True)}


def test_near_large_groups_and_chains(spark):
    """A chain whose ends are far apart, a group of near copies, and texts just under the threshold."""
    base = [f"v{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"n{j}" for j in range(k, 60)]) for k in range(60, 20, -3)]
    texts += [" ".join(base[:i] + ["swap"] + base[i + 1 :]) for i in range(60)]
    docs = list(enumerate(texts))
    found = near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2, tile=8)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == brute.near(docs, 2)


def just_under(spark, n=120):
    """Texts of one boilerplate and own words, just under the threshold, and a few that are similar to one of them only."""
    base = [f"b{i}" for i in range(100)]
    docs = [(d, " ".join(base + [f"o{d}x{i}" for i in range(13)])) for d in range(n)]
    docs += [(n + d, docs[d][1] + f" more{d}") for d in range(5, 100, 9)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string")


def test_near_crowds_under_the_threshold(spark, monkeypatch):
    docs, frame = just_under(spark)
    plans, plan = [], near_module.group_plan
    monkeypatch.setattr(near_module, "group_plan", lambda placed, group: plans.append(plan(placed, group)) or plans[-1])
    found = near_dedup(frame, shingle=2, tile=8)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == brute.near(docs, 2)
    crowd, left = (p.agg(F.max("n")).first()[0] for p in plans[:2])
    assert crowd > 100 and left <= 8  # nothing is left of the crowd: only texts that are similar share keys


def test_near_cells_are_bounded(spark):
    """Of many documents that are a component each, no cell holds more than about two tiles, and each pair meets."""
    tile, n = 64, 640
    placed = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("rep"), F.col("id").alias("component"), F.col("id").alias("part"))
    found = near_module.cells(placed, near_module.group_plan(placed, "key"), "key", tile).toPandas()
    assert found.groupby(["row", "column"]).size().max() < 3 * tile
    met = set()
    for _, cell in found.groupby(["row", "column"]):
        met |= {(a, b) for a in cell.rep[cell.left] for b in cell.rep[cell.right] if a != b}
    assert all((a, b) in met or (b, a) in met for a in range(n) for b in range(a))


def test_empty_tables(no_docs):
    for work in (exact_dedup, line_dedup, dedup_passages, dedup_substrings, near_dedup):
        assert work(no_docs).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(1, 9))
def test_sliding_min(values, width):
    found = sliding_min(np.array(values, np.uint64), width) if len(values) >= width else np.zeros(0)
    assert found.tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 7))
def test_rolling_windows_agree_with_equality(values, width):
    names = Rolling(BASES[0]).windows(np.array(values, np.uint64), width).tolist()
    strings = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(set(zip(names, strings))) == len(set(names)) == len(set(strings))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    pool = mix(rng.integers(0, 1 << 62, 1500).astype(np.uint64))
    a, b = np.sort(pool[:1250]), np.sort(pool[250:])
    signature = signatures(np.concatenate((a, b)), np.array([0, 1250, 2500]), 200)
    assert abs((signature[0] == signature[1]).mean() - 1000 / 1500) < 0.12
    assert band_keys(signature, 40, 5).shape == (2, 40)
