"""The pipeline stage by stage against plain versions, and what the driver's entry registers."""

import brute
import pytest
from pyspark.sql import functions as F
from test_scans import check_packing, leaks

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from quirework.llm import queries
from quirework.llm.quality import score_quality

SMALL = "/root/testdata/sf0.001"


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def rows(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def exact(docs):
    last = {}
    for doc, text in docs:
        key = brute.lower(text)
        last[key] = max(doc, last.get(key, doc))
    return sorted(last.values())


def test_stages_in_order(spark):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # give every later stage something to do: copies, near copies and passages of the benchmark
    more = docs.where("doc_id < 60").select((F.col("doc_id") + 1000).alias("doc_id"), F.upper("text").alias("text"), "lang", "source", "n_chars")
    near = docs.where("doc_id < 60").select((F.col("doc_id") + 2000).alias("doc_id"), F.concat("text", F.lit(" one more sentence")).alias("text"), "lang", "source", "n_chars")
    leaked = docs.where("doc_id BETWEEN 60 AND 70").select((F.col("doc_id") + 3000).alias("doc_id"), F.concat("text", F.lit(" "), F.lit(items[3][1])).alias("text"), "lang", "source", "n_chars")
    docs = docs.union(more).union(near).union(leaked)
    (_, quality), (_, copies), (_, near_copies), (_, decontaminate), (_, pack) = pipeline.STAGES
    kept = quality(spark, docs, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert kept.columns == docs.columns
    assert ids(kept) == ids(score_quality(docs, labels).where("predicted = 1")) and 0 < kept.count() < docs.count()
    unique = copies(spark, docs, SMALL)
    assert unique.columns == docs.columns and ids(unique) == exact(rows(docs)) and unique.count() < docs.count()
    single = near_copies(spark, unique, SMALL)
    assert single.columns == docs.columns
    assert ids(single) == [d for d, _, _, own in brute.near(rows(unique), 5) if own] and single.count() < unique.count()
    clean = decontaminate(spark, single, SMALL)
    hit = {d for d, _ in leaks(rows(single), items)}
    assert clean.columns == docs.columns and hit and ids(clean) == sorted(set(ids(single)) - hit)
    check_packing(pack(spark, clean, SMALL).toPandas(), rows(clean))


def test_whole_run(spark):
    found = pipeline.run(spark, SMALL)
    again = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES:
        again = stage(spark, again, SMALL)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = lambda frame: frame.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens"))
    assert sorted(map(tuple, pieces(found).collect())) == sorted(map(tuple, pieces(again).collect()))


def test_stages_on_edge_cases(spark, edge_docs, no_docs, repeated_docs):
    """Columns of any name and type pass through; nulls, repeats and empty tables do not stop a stage."""
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, edge_docs, SMALL)
        assert out.schema.fieldNames() == edge_docs.schema.fieldNames(), name
        assert [f.dataType for f in out.schema] == [f.dataType for f in edge_docs.schema], name
        assert 0 < out.count() <= edge_docs.count()
        assert stage(spark, no_docs, SMALL).count() == 0
        assert stage(spark, repeated_docs, SMALL).count() <= 6
    assert pipeline.STAGES[-1][1](spark, no_docs, SMALL).count() == 0


def test_exact_stage_tells_texts_of_one_id_apart(spark):
    stage = dict(pipeline.STAGES)["exact dedup"]
    found = [(4, "A b"), (4, "other"), (9, "a B"), (9, "a B"), (None, "n"), (None, "n"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in found], "doc_id long, text string, digest int, copy int")
    kept = stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(map(str, rows(kept))) == sorted(map(str, [(4, "other"), (9, "a B"), (None, "n"), (None, None)]))


def test_registered_queries():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert names["pipeline"] is pipeline.run
    assert set(queries.ORACLES) == {"op7_line_windows", "op10_tree_merge", "op11_l2ap_negatives", "op12_exponential_keys"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op7_line_windows", "op10_tree_merge"])
def test_native_operators_stay_in_the_jvm(spark, name):
    frame = queries.QUERIES[name](spark, SMALL)
    plan = frame._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
