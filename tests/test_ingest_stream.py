"""Continuous ingest: retries, duplicates, supersession, and failures at each point of a batch."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_registry import F_, I_, THAI, corpus

from quirework.functions import vectors as V
from quirework.functions.common import materialize, scratch_path, temporary_tables
from quirework.operators import ingestion, lexical as L, supersede as S
from quirework.plans import fixtures
from quirework.sources import versions
from quirework.streaming import ingest_stream as N

AT = F.lit("2026-01-01 00:00:00")
VOLUMES = "document_id string, text string, year int, scope string, page_count int"


def arrive(spark, source, *volumes):
    spark.createDataFrame(volumes, VOLUMES).coalesce(1).write.mode("append").parquet(source)


def extract(batch):
    return corpus(batch.sparkSession, *((r.document_id, r.text, r.year, [r.scope], r.page_count) for r in batch.collect()))


def run(spark, source, root):
    stream = spark.readStream.schema(VOLUMES).option("maxFilesPerTrigger", 1).parquet(source)
    N.ingest_stream(stream, root, extract, V.hashing_embedder(8), 8, "m", AT).awaitTermination()
    return seen(spark, root)


def seen(spark, root):
    now = N.read_corpus(spark, root)
    states = {r["document_id"]: (r["status"], r["chunk_count"]) for r in now["documents"].collect()}
    held = {r["document_id"] for r in now["chunks"].collect()}
    assert S.check_corpus(now["documents"], now["chunks"], 8).isEmpty()
    built = L.stored_postings(now["chunks"]).select("term", "chunk_id", "positions")
    stored = now["postings"].select("term", "chunk_id", "positions")
    assert built.exceptAll(stored).isEmpty() and stored.exceptAll(built).isEmpty()
    return states, held


def test_lifecycle_over_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, source, ("a", THAI, 2565, F_, 1), ("b", "no thai here", 2566, I_, 1), ("c", THAI, 2566, I_, 2))
    assert run(spark, source, root) == ({"a": ("active", 1), "b": ("pending", None), "c": ("pending", None)}, {"a"})

    arrive(spark, source, ("c", THAI, 2566, I_, 1), ("a", "changed", 2565, F_, 1))  # c is corrected, a is refused
    states, held = run(spark, source, root)
    assert states == {"a": ("active", 1), "b": ("pending", None), "c": ("active", 1)} and held == {"a", "c"}

    arrive(spark, source, ("e", THAI, 2568, F_, 1))  # a newer edition of a
    states, held = run(spark, source, root)
    assert states["a"] == ("archived", 1) and states["e"] == ("active", 1) and held == {"c", "e"}
    assert run(spark, source, root) == (states, held)  # nothing new arrives


@pytest.mark.parametrize("lost", ["after the data", "after the generation"])
def test_a_batch_is_replayed_after_a_failure(spark, tmp_path, monkeypatch, lost):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, source, ("a", THAI, 2565, F_, 1))
    before = run(spark, source, root)
    arrive(spark, source, ("e", THAI, 2568, F_, 1), ("b", "no thai here", 2566, I_, 1))
    publish = versions._publish_state

    def fails(*args):
        if lost == "after the generation":
            publish(*args)
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "_publish_state", fails)
        with pytest.raises(Exception, match="lost"):
            run(spark, source, root)
    after = ({"a": ("archived", 1), "e": ("active", 1), "b": ("pending", None)}, {"e"})
    assert seen(spark, root) == (after if lost == "after the generation" else before)
    number = versions.state(spark, root)["generation"]
    assert run(spark, source, root) == after
    assert versions.state(spark, root)["generation"] == (number if lost == "after the generation" else number + 1)


def test_the_stream_leaves_what_one_batch_does(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    volumes = [(f"d{i}", THAI if i % 3 else "plain", 2560 + i % 4, (F_, I_)[i % 2], 1 + (i == 5)) for i in range(8)]
    for at in range(0, 8, 3):
        arrive(spark, source, *volumes[at : at + 3])
    states, held = run(spark, source, root)
    empty = [spark.createDataFrame([], N.TABLES[t]) for t in ("documents", "chunks")]
    columns = [f.split()[0] for f in N.TABLES["chunks"].split(", ")]
    inputs = corpus(spark, *((d, t, y, [s], n) for d, t, y, s, n in volumes))
    documents, chunks, _ = ingestion.ingest(*inputs, empty[0], empty[1].select(*columns), V.hashing_embedder(8), 8, "m", AT)
    assert states == {r["document_id"]: (r["status"], r["chunk_count"]) for r in documents.collect()}
    assert held == {r["document_id"] for r in chunks.collect()} and len(held) > 1


def test_scratch_tables_of_a_scope_are_deleted(spark):
    with temporary_tables(spark) as folder:
        frame = materialize(spark.range(3), "rows")
        assert frame.count() == 3 and Path(folder.removeprefix("file:")).exists()
    assert not Path(folder.removeprefix("file:")).exists()
    assert not scratch_path(spark, "later").startswith(folder)


def test_passages_archived_in_their_own_batch_are_counted_but_not_embedded(spark):
    """the model was called for passages that a newer edition of the batch archived at once."""
    batch = corpus(spark, ("a", THAI, 2565, [F_], 1), ("e", THAI + " new", 2568, [F_], 1))
    nothing = spark.createDataFrame([], N.TABLES["documents"])

    def only_new(tokens):
        refused = F.raise_error(F.lit("an archived passage is embedded")).cast("array<float>")
        return F.when(~F.array_contains(tokens, "new"), refused).otherwise(F.array(F.lit(1.0).cast("float")))

    done = ingestion.ingest_changes(*batch, nothing, only_new, 1, "m", AT)
    states = {r["document_id"]: (r["status"], r["chunk_count"], r["embedding_model"]) for r in done.documents.collect()}
    assert states == {"a": ("archived", 1, "m"), "e": ("active", 1, "m")}
    assert [r["document_id"] for r in done.chunks.collect()] == ["e"]


def test_pages_are_cut_in_their_rows(spark):
    """every step that reads pages joined the texts with themselves for one more column."""
    pages = fixtures.pages_of(spark.createDataFrame([(1, "a\nb\nc\nd", "s")], "document_id long, text string, source string"))
    assert "Join" not in pages._jdf.queryExecution().optimizedPlan().toString()
    assert [r["raw_text"].split("\n")[0] for r in pages.orderBy("ordinal").collect()] == ["Handbook s   1", "Handbook s   2"]
