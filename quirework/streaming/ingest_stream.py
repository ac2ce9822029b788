"""Continuous ingestion: arriving documents are gated, chunked, embedded, promoted and published batch by batch."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quirework.functions.common import materialize, temporary_tables
from quirework.operators.ingestion import ingest_changes
from quirework.operators.lexical import POSTINGS, stored_postings
from quirework.sources import schemas, versions as V

SOURCE = "arrivals"
TABLES = {"documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "postings": POSTINGS}


def read_corpus(spark: SparkSession, root: str, generation: int | None = None) -> dict[str, DataFrame]:
    """documents, chunks and postings of one and the same generation, the newest by default."""
    number = V.state(spark, root, generation)["generation"]
    return {name: V.read(spark, root, name, schema, generation=number) for name, schema in TABLES.items()}


def publish_batch(
    spark: SparkSession,
    root: str,
    inputs: tuple[DataFrame, DataFrame, DataFrame, DataFrame],
    embedder,
    dimension: int,
    model: str,
    at: Column,
    source: str | None = None,
    batch: int | None = None,
    **options,
) -> int:
    """Ingest (files, pages, blocks, tables) into the store and publish registry, passages and postings as one generation."""
    registry = V.read(spark, root, "documents", schemas.DOCUMENTS)
    done = ingest_changes(*inputs, registry, embedder, dimension, model, at, **options)
    chunks = done.chunks.select(*(f.split()[0] for f in schemas.CHUNKS.split(", ")))
    changes = {
        "documents": V.Change(done.changed, done.removed),
        "chunks": V.Change(chunks, done.removed),
        "postings": V.Change(stored_postings(chunks), done.removed),
    }
    return V.publish(spark, root, changes, source, batch)


def compact_corpus(spark: SparkSession, root: str, **limits) -> None:
    """Merge the deltas of each table that has too many; postings lie in order of their terms."""
    for name, schema in TABLES.items():
        V.compact(spark, root, name, schema, cluster=[F.col("term"), F.col("chunk_id")] if name == "postings" else (), **limits)


def ingest_stream(
    arrivals: DataFrame,
    root: str,
    extract: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame, DataFrame]],
    embedder,
    dimension: int,
    model: str,
    at: Column,
    source: str = SOURCE,
    **options,
) -> StreamingQuery:
    """Ingest each micro-batch of arriving files into the store at ``root``; one batch is in flight at a time.

    ``extract`` turns a batch into (files, pages, blocks, tables). What the batch changes becomes visible in
    one generation that also says that the batch is done, before its offset is committed: a batch that is run
    again after a failure finds either nothing of it or all, and changes nothing in the latter case. Hashes
    that are active or archived are refused, pending ones are tried again. Tables of a batch in the shared
    folder are deleted when it ends.
    """
    spark = arrivals.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        if V.done(spark, root, source) >= batch_id:
            return
        with temporary_tables(spark):
            inputs = extract(materialize(batch.hint("rebalance"), "arrived"))  # files arrive in any size
            publish_batch(spark, root, inputs, embedder, dimension, model, at, source, batch_id, **options)
        compact_corpus(spark, root)

    return (
        arrivals.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
