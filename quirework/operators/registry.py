"""Document registry: admission of files, lookups by content hash, statistics, object claims."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.operators.quality import qa_record
from quirework.sources import schemas

# Names an upload may have, and the largest object accepted.
CLAIMABLE_NAME = r"\Auploads/[0-9a-f]{32}\.pdf\z"
MAX_OBJECT_BYTES = 512 * 1024 * 1024


def document_id_for(file_hash: Column) -> Column:
    return F.sha2(F.concat(F.lit("document/"), file_hash), 256)


def first_of_each_hash(files: DataFrame, order: str) -> DataFrame:
    """One file per content hash; the rank limit is applied before the shuffle too."""
    rank = Window.partitionBy("file_hash").orderBy(order)
    return files.withColumn("copy", F.row_number().over(rank)).filter("copy = 1").drop("copy")


def lookup_by_hash(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, status) of each file hash, null where the registry has none."""
    known = documents.select("file_hash", "document_id", "status")
    return files.join(known, "file_hash", "left")


def admission_action(status: Column) -> Column:
    """insert a new file, update one still pending, refuse any other."""
    return F.when(status.isNull(), "insert").when(status == "pending", "update").otherwise("refuse")


def admission(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``action`` to files by what the registry holds under their hash."""
    return lookup_by_hash(files, documents).withColumn("action", admission_action(F.col("status")))


def ingest_summary(
    hashes: DataFrame, documents: DataFrame, in_flight: DataFrame
) -> DataFrame:
    """State of each hash: its document's status, in_progress while in flight, or not_found."""
    known = documents.select("file_hash", "document_id", "status", "qa", "chunk_count")
    flying = in_flight.select("file_hash").distinct().withColumn("in_flight", F.lit(True))
    return (
        hashes.join(known, "file_hash", "left")
        .join(flying, "file_hash", "left")
        .withColumn(
            "state",
            F.when(F.col("status").isNotNull(), F.col("status"))
            .when(F.col("in_flight"), "in_progress")
            .otherwise("not_found"),
        )
        .drop("in_flight", "status")
    )


def pending_rows(files: DataFrame, qa: DataFrame, ingested_at: Column, parser: str) -> DataFrame:
    """Registry rows of admitted files: pending, with the whole gate record."""
    return files.join(qa_record(qa), "document_id", "left").select(
        "document_id",
        "source",
        "title_th",
        F.col("edition_year_be").cast("smallint").alias("edition_year_be"),
        "scopes",
        F.lit("pending").alias("status"),
        "file_hash",
        F.col("page_count").cast("int").alias("page_count"),
        F.lit(None).cast("bigint").alias("chunk_count"),
        F.lit(parser).alias("parser"),
        F.lit(None).cast("string").alias("embedding_model"),
        F.col("qa").cast(schemas.QA_RECORD).alias("qa"),
        ingested_at.cast("timestamp").alias("ingested_at"),
        F.lit(None).cast("timestamp").alias("archived_at"),
    )


def overwrite_qa(documents: DataFrame, qa: DataFrame) -> DataFrame:
    """New gate records replace the stored ones; other columns keep their values."""
    fresh = qa_record(qa).withColumnRenamed("qa", "new_qa")
    return (
        documents.join(fresh, "document_id", "left")
        .withColumn("qa", F.coalesce(F.col("new_qa").cast(schemas.QA_RECORD), F.col("qa")))
        .select(*documents.columns)
    )


def clear_pending_chunks(chunks: DataFrame, documents: DataFrame, reingested: DataFrame) -> DataFrame:
    """Chunks left after dropping those of re-ingested documents that are still pending."""
    cleared = documents.filter("status = 'pending'").join(reingested, "document_id", "left_semi")
    return chunks.join(cleared.select("document_id"), "document_id", "left_anti")


def chunk_statistics(
    documents: DataFrame, passed: DataFrame, chunks: DataFrame, model: str
) -> DataFrame:
    """Set chunk_count, 0 included, and the embedding model of every document that passed."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    counted = (
        passed.select("document_id").distinct().join(counts, "document_id", "left")
        .select("document_id", F.coalesce("n", F.lit(0)).alias("n"))
    )
    return (
        documents.join(counted, "document_id", "left")
        .withColumn("chunk_count", F.coalesce("n", "chunk_count"))
        .withColumn(
            "embedding_model",
            F.when(F.col("n").isNotNull(), F.lit(model)).otherwise(F.col("embedding_model")),
        )
        .select(*documents.columns)
    )


def archive_manifest(files: DataFrame, passed: DataFrame) -> DataFrame:
    """Copy list of accepted sources: one target per content hash."""
    accepted = files.join(passed.select("document_id"), "document_id", "left_semi")
    return first_of_each_hash(accepted, "document_id").select(
        "file_hash",
        "source",
        F.concat(F.lit("documents/"), F.col("file_hash"), F.lit(".pdf")).alias("target"),
    )


def claim_objects(
    requested: DataFrame, listing: DataFrame, max_bytes: int = MAX_OBJECT_BYTES
) -> DataFrame:
    """(object_name, claimable, reason) for each requested upload."""
    sizes = listing.select("object_name", "size")
    return requested.join(sizes, "object_name", "left").select(
        "object_name",
        "size",
        F.when(~F.col("object_name").rlike(CLAIMABLE_NAME), "bad name")
        .when(F.col("size").isNull(), "missing")
        .when(F.col("size") > max_bytes, "too large")
        .alias("reason"),
    ).withColumn("claimable", F.col("reason").isNull())


def models_off_pin(documents: DataFrame, pinned: str) -> DataFrame:
    """Distinct embedding models of active documents other than the pinned one; a missing
    model counts, an empty corpus passes."""
    return (
        documents.filter("status = 'active'")
        .select("embedding_model")
        .distinct()
        .filter(~F.col("embedding_model").eqNullSafe(F.lit(pinned)))
    )
