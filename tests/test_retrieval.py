import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quirework.functions import text as T, vectors as V
from quirework.operators import dense as D, dense_cells as N, evaluation as E, lexical as L, rerank as K, retrieval as H
from quirework.operators.ordered import running_sums, with_following


def chunks_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")


def questions_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")


def ranked(df):
    return [(r["question_id"], r["chunk_id"]) for r in df.orderBy("question_id", "rank").collect()]


TEXTS = ["red apple pie", "green apple", "apple and red wine red", "plum", ""]


def test_all_terms_must_match(spark):
    found = L.lexical_topk(questions_of(spark, ["red apple", "apple missing", " ", "Apple!"]), chunks_of(spark, TEXTS), 5, "tf")
    assert ranked(found) == [(0, 2), (0, 0), (3, 0), (3, 1), (3, 2)]


def test_cover_density_prefers_close_terms(spark):
    texts = ["red x x x apple", "red apple", "apple red apple"]
    found = L.lexical_topk(questions_of(spark, ["red apple"]), chunks_of(spark, texts), 5).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in found] == [(2, 0.2), (1, 0.1), (0, 0.025)]


def plain_cover(words, terms):
    """Spans in which every term occurs and no smaller one lies, weighed by the words that are no terms."""
    places = [i for i, w in enumerate(words) if w in terms]
    spans = []
    for b, end in enumerate(places):
        for a in range(b, -1, -1):
            if {words[i] for i in places[a : b + 1]} == set(terms):
                spans.append((a, b))
                break
    least = [(a, b) for a, b in spans if not any((x, y) != (a, b) and a <= x and y <= b for x, y in spans)]
    return sum(L.COVER_WEIGHT / (1 + places[b] - places[a] - (b - a)) for a, b in least)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcdxyz"), max_size=25), min_size=1, max_size=30), st.lists(st.sampled_from("abcd"), min_size=1, max_size=4, unique=True))
def test_cover_density_equals_the_plain_version(spark, texts, terms):
    chunks = chunks_of(spark, [" ".join(t) for t in texts])
    want = {i: round(plain_cover(t, terms), 6) for i, t in enumerate(texts) if set(terms) <= set(t)}
    asked = questions_of(spark, [" ".join(terms)])
    found = {r["chunk_id"]: r["score"] for r in L.lexical_topk(asked, chunks, 99).collect()}
    stored = L.stored_postings(chunks.select(F.col("chunk_id").cast("string"), F.lit("d").alias("document_id"), T.tokenize(F.col("content")).alias("tokens")))
    indexed = {int(r["chunk_id"]): r["score"] for r in L.postings_topk(asked, stored, 99).collect()}
    assert found == indexed == want


def test_postings_search_equals_the_scan(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30))) for _ in range(120)]
    chunks = chunks_of(spark, texts).select(F.format_string("%03d", "chunk_id").alias("chunk_id"), F.lit("d").alias("document_id"), "content")
    index = L.stored_postings(chunks.withColumn("tokens", T.tokenize(F.col("content"))))
    asked = questions_of(spark, ["a", "a b", "h g f", "a a a", "missing a", "", "c d e f"])
    for rank in ("cover", "tf"):
        want = sorted(map(tuple, L.lexical_topk(asked, chunks, 9, rank).collect()))
        assert sorted(map(tuple, L.postings_topk(asked, index, 9, rank).collect())) == want and want
    plan = L.postings_topk(asked, index, 9)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan  # the index meets broadcast rows in place
    monkeypatch.setattr(L, "broadcast_within_bound", lambda df: df)
    assert sorted(map(tuple, L.postings_topk(asked, index, 9, "tf").collect())) == want


def test_postings_are_cut_from_a_chunk_without_a_shuffle(spark):
    """a row per token was shuffled."""
    chunks = chunks_of(spark, ["b a b", "", "c"]).select("chunk_id", F.lit(1).alias("document_id"), T.tokenize(F.col("content")).alias("tokens"))
    found = L.stored_postings(chunks)
    assert sorted(tuple(r[:2]) + (r[3],) for r in found.collect()) == [("a", 0, [2]), ("b", 0, [1, 3]), ("c", 2, [1])]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_questions_of_one_term_need_no_candidates(spark, monkeypatch):
    """F6-F8: every posting of a single frequent word was written and joined to itself."""
    written, materialize = {}, L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
    index = L.stored_postings(chunks_of(spark, ["a b", "a", "a c"]).select("chunk_id", F.lit(1).alias("document_id"), T.tokenize(F.col("content")).alias("tokens")))
    assert ranked(L.postings_topk(questions_of(spark, ["a", "a b"]), index, 9)) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert written["wanted"].count() == 2


def test_questions_with_unmapped_codes_are_not_searched(spark):
    docs = spark.createDataFrame([(1, 2568, "t", "s")], "document_id int, edition_year_be int, title_th string, source string")
    chunks = spark.createDataFrame([(1, 1, 1, None, "red apple")], "chunk_id int, document_id int, page_number int, section string, content string")
    embed = V.hashing_embedder(64)
    chunks = chunks.withColumn("embedding", embed(F.split("content", " ")))
    asked = questions_of(spark, ["red apple", "red \uf707 apple"])
    assert [r["question_id"] for r in H.retrieve(asked, chunks, docs, embed).collect()] == [0]
    assert [tuple(r) for r in H.refused_questions(asked).collect()] == [(1, ["U+F707"])]


def test_the_default_embedder_counts_tokens_by_hash(evaluate):
    tokens = [["red", "red", "apple"], [], ["x"] * 300, None]
    slot = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 16
    want = [None if t is None else [float(sum(slot(w) == d for w in t)) for d in range(16)] for t in tokens]
    assert evaluate(V.hashing_embedder(16)(F.col("x")), tokens, "array<string>") == want


@pytest.mark.parametrize("records", [3, 10_000])
def test_model_calls_are_bounded_and_full(spark, records):
    """Each vector says how large its call was and where it stood in it."""

    def client():
        return lambda texts: [[float(len(texts)), float(i), float(t)] for i, t in enumerate(texts)]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        rows = spark.range(0, 47, 1, 1).select("id", F.when(F.col("id") % 5 != 4, F.col("id").cast("string")).alias("x"))
        found = rows.select("id", V.model_embedder(client, 3, most=10)("x").alias("v")).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["v"] is None for r in found] == [i % 5 == 4 for i in range(47)]
    assert all(r["v"][2] == r["id"] for r in found if r["v"])
    assert all(r["v"][0] <= 10 for r in found if r["v"])
    calls = sum(r["v"][1] == 0 for r in found if r["v"])
    assert calls == 5  # four full ones of ten rows, nulls included, and the last
    empty = spark.createDataFrame([], "x string")
    assert empty.select(V.model_embedder(lambda: 1 / 0, 3)("x")).count() == 0


@pytest.mark.parametrize("answer, message", [("[[1.0]] * len(t)", "expected 3 dimensions, got 1"), ("[]", "0 vectors for 4 inputs")])
def test_wrong_answers_of_a_model_fail(spark, answer, message):
    client = eval(f"lambda: lambda t: {answer}")
    rows = spark.range(0, 4, 1, 1).select(F.col("id").cast("string").alias("x"))
    with pytest.raises(Exception, match=message):
        rows.select(V.model_embedder(client, 3)("x")).collect()


def test_the_shuffle_path_finds_the_same(spark, monkeypatch):
    args = questions_of(spark, ["red apple", "apple"]), chunks_of(spark, TEXTS), 5
    small = ranked(L.lexical_topk(*args))
    monkeypatch.setattr(L, "fits_broadcast", lambda df: False)
    assert ranked(L.lexical_topk(*args)) == small


def test_postings_hold_positions(spark):
    rows = L.postings(chunks_of(spark, ["b a b"])).orderBy("token").collect()
    assert [(r["token"], r["tf"], r["positions"]) for r in rows] == [("a", 1, [2]), ("b", 2, [1, 3])]


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(300, 8)).astype("float32")
    data[10:110] = data[10]  # a third of the rows are copies of one passage
    data[5] = 0
    return data, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "chunk_id int, embedding array<float>")


def brute_force(data, asked, k):
    with np.errstate(invalid="ignore"):
        unit = data.astype("float64") / np.linalg.norm(data.astype("float64"), axis=1, keepdims=True)
    out = []
    for q in asked:
        scores = np.round(unit @ unit[q], 6)
        order = sorted((c for c in range(len(data)) if not np.isnan(scores[c])), key=lambda c: (-scores[c], c))
        out += [(q, c) for c in order[:k]]
    return out


@pytest.mark.parametrize("blocked", [False, True])
def test_dense_topk_is_exact_on_copies_and_blocks(spark, vectors, blocked):
    data, chunks = vectors
    asked = [0, 10, 50, 200]
    questions = chunks.filter(F.col("chunk_id").isin(asked)).withColumnRenamed("chunk_id", "question_id")
    bounds = dict(query_block=2, chunk_block=64) if blocked else {}
    assert ranked(D.dense_topk(questions, chunks, 7, **bounds)) == brute_force(data, asked, 7)


@pytest.mark.parametrize("cells", [0, 3])
def test_small_blocks_copy_rows_no_more_often(spark, vectors, monkeypatch, cells):
    """rows were copied, and results kept, once per block of the other side."""
    data, chunks = vectors
    monkeypatch.setattr(D, "CHUNK_SLICE", 32, raising=False)  # many batches, so the running bounds take part
    questions = chunks.withColumnRenamed("chunk_id", "question_id")
    merged, top_k = [], D.top_k
    for module in (D, N):
        monkeypatch.setattr(module, "top_k", lambda rows, k: merged.append(rows) or top_k(rows, k))
    if cells:
        centroids = N.fit_centroids(chunks, cells)
        found = N.dense_topk_cells(questions, N.index_cells(chunks, centroids), centroids, 7, cells, query_block=2, chunk_block=4)
    else:
        found = D.dense_topk(questions, chunks, 7, query_block=2, chunk_block=4)
    assert ranked(found) == brute_force(data, [q for q in range(300) if q != 5], 7)
    assert merged[-1].count() <= 299 * 7 * max(cells, 1)


@pytest.mark.parametrize("cells, blocks", [(1, {}), (9, {}), (9, dict(query_block=2, chunk_block=16))])
def test_all_cells_find_what_the_exact_search_does(spark, vectors, cells, blocks):
    data, chunks = vectors
    asked = [0, 10, 50, 200]
    questions = chunks.filter(F.col("chunk_id").isin(asked)).withColumnRenamed("chunk_id", "question_id")
    centroids = N.fit_centroids(chunks, cells)
    found = N.dense_topk_cells(questions, N.index_cells(chunks, centroids), centroids, 7, cells, **blocks)
    assert ranked(found) == brute_force(data, asked, 7)


def test_few_cells_reach_the_wanted_recall_on_clusters(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 16))
    data = (middles[rng.integers(0, 12, 900)] + rng.normal(scale=0.2, size=(900, 16))).tolist()
    chunks = spark.createDataFrame([(i, v) for i, v in enumerate(data)] + [(900, None), (901, [0.0] * 16)], "chunk_id int, embedding array<float>")
    questions = chunks.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "question_id")
    centroids = N.fit_centroids(chunks, 24)
    probes, reached = N.probes_for(0.9, questions, chunks, N.index_cells(chunks, centroids), centroids, 10)
    assert reached >= 0.9 and probes <= 8


def test_cells_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id int, embedding array<float>")
    centroids = N.fit_centroids(none, 4)
    asked = none.withColumnRenamed("chunk_id", "question_id")
    assert N.dense_topk_cells(asked, N.index_cells(none, centroids), centroids, 3, 2).isEmpty()


def test_fusion_keeps_one_sided_hits(spark):
    schema = "question_id int, chunk_id int, rank int"
    dense = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], schema)
    lexical = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], schema)
    rows = H.reciprocal_rank_fusion([dense, lexical]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == [2, 1, 3]
    assert rows[0]["fusion_score"] == round(1 / 62 + 1 / 61, 9)


def test_retrieve_drops_vanished_chunks_and_blank_questions(spark):
    docs = spark.createDataFrame([(1, 2568, "t", "s")], "document_id int, edition_year_be int, title_th string, source string")
    chunks = spark.createDataFrame(
        [(1, 1, 1, None, "red apple"), (2, 9, 1, None, "red apple orphan")],
        "chunk_id int, document_id int, page_number int, section string, content string",
    )
    embed = V.hashing_embedder(64)
    chunks = chunks.withColumn("embedding", embed(F.split("content", " ")))
    rows = H.retrieve(questions_of(spark, ["red apple", "  "]), chunks, docs, embed).collect()
    assert [(r["question_id"], r["chunk_id"], r["rank"], r["title_th"]) for r in rows] == [(0, 1, 1, "t")]


def scored_of(spark, scores):
    return spark.createDataFrame([(1, i + 1, float(s)) for i, s in enumerate(scores)], "question_id int, rank int, score double")


def test_rerank_order_ties_and_threshold(spark):
    kept = K.rerank(scored_of(spark, [0.5, 0.9, 0.1, 0.7, 0.2, 0.8, 0.3, 0.6]), 0.3).orderBy("number").collect()
    assert [r["rank"] for r in kept] == [2, 6, 4, 8, 1]
    tied = spark.createDataFrame([(1, 3, 0.5), (1, 1, 0.5), (1, 2, 0.5)], "question_id int, rank int, score double")
    assert [r["rank"] for r in K.rerank(tied).orderBy("number").collect()] == [1, 2, 3]
    assert K.rerank(scored_of(spark, [0.42, 0.4199])).count() == 1


def test_scorer_contract(spark):
    passages = spark.createDataFrame([(q, r) for q in range(6) for r in (1, 2)], "question_id int, rank int")
    responses = spark.createDataFrame(
        [
            (0, [(1, 0.2), (0, 0.9)]),
            (1, [(0, 0.2)]),
            (2, [(0, 0.2), (0, 0.3)]),
            (3, [(0, 0.2), (2, 0.3)]),
            (4, [(0, 0.2), (1, 1.01)]),
        ],
        "question_id int, results array<struct<index:int,relevance_score:double>>",
    )
    broken = {r["question_id"]: r["violation"] for r in K.scorer_violations(passages, responses).collect()}
    assert broken == {
        1: "count", 2: "duplicate index", 3: "index out of range", 4: "score out of range", 5: "count",
    }
    aligned = K.align_scores(passages, responses).orderBy("rank").collect()
    assert [(r["question_id"], r["rank"], r["score"]) for r in aligned] == [(0, 1, 0.9), (0, 2, 0.2)]


def test_default_scorer(evaluate):
    score = K.token_overlap_score(F.lit("Red apple red"), F.col("x"))
    assert evaluate(score, ["an apple", "a RED apple", ""]) == [0.5, 1.0, 0.0]


def sweep_by_hand(flagged, questions, thresholds, k):
    out = []
    for t in thresholds:
        pos = neg = 0
        for q, answerable in questions.items():
            rows = sorted((r for r in flagged if r[0] == q), key=lambda r: (-r[2], r[1]))
            kept = [r for r in rows if r[2] >= t][:k]
            pos += answerable and any(r[3] for r in kept)
            neg += (not answerable) and not kept
        out.append((t, pos, neg))
    return out


def test_threshold_sweep_against_brute_force(spark):
    rng = np.random.default_rng(3)
    questions = {q: bool(q % 3) for q in range(40)}
    flagged = [
        (q, r, float(rng.choice([0.0, 0.25, 1.0, round(float(rng.random()), 3)])), bool(rng.random() < 0.2 and q % 3))
        for q in questions if q % 7
        for r in range(1, 9)
    ]
    df = spark.createDataFrame(flagged, "question_id int, rank int, score double, hit boolean")
    asked = spark.createDataFrame(list(questions.items()), "question_id int, answerable boolean")
    thresholds = sorted(r["threshold"] for r in E.candidate_thresholds(df).collect())
    scores = sorted({r[2] for r in flagged})
    assert thresholds == sorted([0.0, *((a + b) / 2 for a, b in zip(scores, scores[1:])), scores[-1] + 1e-6])
    sweep = E.threshold_sweep(df, asked, E.candidate_thresholds(df), 5)
    rows = sorted((r["threshold"], r["positives_kept"], r["negatives_refused"]) for r in sweep.collect())
    expected = sweep_by_hand(flagged, questions, thresholds, 5)
    assert rows == expected
    most = max(p for _, p, _ in expected)
    refusing = max(n for _, p, n in expected if p == most)
    best = E.best_threshold(sweep).first()
    assert best["threshold"] == min(t for t, p, n in expected if (p, n) == (most, refusing))


@pytest.mark.parametrize("low, high", [(0.5, 0.5001), (-7.0, 9.0), (3.0, 3.0)])
def test_sweep_of_any_distribution(spark, low, high):
    """Scores in a narrow band, outside [0, 1], and all the same."""
    rng = np.random.default_rng(4)
    questions = {q: bool(q % 2) for q in range(60)}
    flagged = [(q, r, float(rng.uniform(low, high)), bool(q % 2 and rng.random() < 0.4)) for q in questions for r in range(1, 6)]
    df = spark.createDataFrame(flagged, "question_id int, rank int, score double, hit boolean")
    asked = spark.createDataFrame(list(questions.items()), "question_id int, answerable boolean")
    thresholds = E.candidate_thresholds(df)
    scores = sorted({r[2] for r in flagged})
    want = sorted([0.0, *((a + b) / 2 for a, b in zip(scores, scores[1:])), scores[-1] + 1e-6])
    assert sorted(r["threshold"] for r in thresholds.collect()) == want
    rows = sorted((r["threshold"], r["positives_kept"], r["negatives_refused"]) for r in E.threshold_sweep(df, asked, thresholds, 3).collect())
    assert rows == sweep_by_hand(flagged, questions, sorted(set(want)), 3)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_running_sums(spark, ranges):
    rng = np.random.default_rng(ranges)
    rows = [(None if g == 3 else int(g), int(v), i, None if v % 5 == 0 else float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 50, 300)))]
    df = spark.createDataFrame(rows, "g int, v int, range_no int, x double")
    found = running_sums(df, {"n": "v", "xs": "x"}, [F.desc("v"), F.col("range_no")], ["g"], ranges=ranges)
    assert found.columns == ["g", "v", "range_no", "x", "n", "xs"] and found.count() == 300
    for r in found.collect():
        before = [o for o in rows if o[0] == r["g"] and (-o[1], o[2]) < (-r["v"], r["range_no"])]
        assert (r["n"], r["xs"]) == (sum(o[1] for o in before), sum(o[3] or 0 for o in before))
    assert running_sums(df.limit(0), {"n": "v"}, [F.col("v")], ranges=ranges).isEmpty()


@pytest.mark.parametrize("ranges", [1, 7])
def test_following_values(spark, ranges):
    values = [v * v * 0.01 - 1 for v in range(50)]
    df = spark.createDataFrame([(v,) for v in values[::-1]], "v double")
    found = {r["v"]: r["next"] for r in with_following(df, "v", "next", ranges=ranges).collect()}
    assert found == dict(zip(values, [*values[1:], None]))


def test_no_scores_give_one_threshold(spark):
    empty = spark.createDataFrame([], "question_id int, rank int, score double, hit boolean")
    assert [r["threshold"] for r in E.candidate_thresholds(empty).collect()] == [0.0]


def test_missing_section_equals_missing_section(evaluate):
    rule = E.is_expected(F.lit("a\n b"), F.col("x"), F.lit("a b"), F.lit(None).cast("string"))
    assert evaluate(rule, [None, "s"]) == [True, False]


def test_vectors_and_postings_of_odd_token_rows(spark):
    """both are counted over whole Arrow batches; null and empty rows stand between others."""
    rows = [("r0", 1, None), ("r1", 2, ["b", "a", "b"]), ("r2", 3, []), ("r3", 4, ["b"] * 3), ("r4", 5, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id long, tokens array<string>").coalesce(1)
    found = sorted(tuple(r) for r in L.stored_postings(chunks).collect())
    assert found == [("a", "r1", 2, [2]), ("b", "r1", 2, [1, 3]), ("b", "r3", 4, [1, 2, 3])]
    vectors = {r[0]: r[1] for r in chunks.select("chunk_id", V.hashing_embedder(8)("tokens").alias("v")).collect()}
    assert vectors["r0"] is None and vectors["r4"] is None and vectors["r2"] == [0.0] * 8
    assert sum(vectors["r1"]) == sum(vectors["r3"]) == 3


def test_the_live_store_holds_nothing_that_was_dropped(spark):
    """every passage was stored, then those of inactive documents removed by writing the rest again in few tasks."""
    from quirework.plans import fixtures as X, retrieval_plans as R
    from quirework.sources import versions as S

    sf = "/root/testdata/sf0.001"
    live = R._live_store(spark.sparkContext.applicationId, sf)
    assert all(len(deltas) == 1 and deltas[0]["removed"] is None for deltas in S.state(spark, live)["tables"].values())
    active = X.registry(spark, sf).filter("status = 'active'").select("document_id")
    for table in ("chunks", "postings"):
        held, every = (R.stored(spark, sf, table, g) for g in (R._LIVE, R._ALL))
        want = every.join(active, "document_id", "left_semi").select(held.columns)
        assert held.exceptAll(want).isEmpty() and want.exceptAll(held).isEmpty() and held.count() > 0
