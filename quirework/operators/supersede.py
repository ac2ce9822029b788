"""Edition supersession and the integrity checks that guard it."""

from pyspark.sql import Column, DataFrame, functions as F

from quirework.functions.text import is_blank, sha256, split_lines, unknown_scopes
from quirework.sources.schemas import ALLOWED_SCOPES, STATUSES


def newest_edition_per_scope(documents: DataFrame) -> DataFrame:
    """Newest year per scope among active and archived documents: one row per scope."""
    return (
        documents.filter(F.col("status").isin("active", "archived"))
        .select(F.explode("scopes").alias("scope"), "edition_year_be")
        .groupBy("scope")
        .agg(F.max("edition_year_be").alias("newest_year"))
    )


def superseded(documents: DataFrame) -> DataFrame:
    """Active documents each of whose scopes has a strictly newer edition.

    A newer edition exists for a scope exactly when the scope's newest year is larger, so
    documents are not compared with each other. The joined side holds one row per scope.
    """
    newest = newest_edition_per_scope(documents)
    per_scope = documents.filter("status = 'active'").select(
        "document_id", "edition_year_be", F.explode("scopes").alias("scope")
    )
    covered = F.coalesce(F.col("newest_year") > F.col("edition_year_be"), F.lit(False))
    return (
        per_scope.join(newest, "scope", "left")
        .groupBy("document_id")
        .agg(F.bool_and(covered).alias("covered"))
        .filter("covered")
        .select("document_id")
    )


def activate(documents: DataFrame, newly_passed: DataFrame) -> DataFrame:
    """Pending documents that passed become active."""
    passed = newly_passed.select("document_id").distinct().withColumn("passed", F.lit(True))
    goes_live = F.col("passed") & (F.col("status") == "pending")
    return (
        documents.join(passed, "document_id", "left")
        .withColumn("status", F.when(goes_live, "active").otherwise(F.col("status")))
        .select(*documents.columns)
    )


def archive_superseded(documents: DataFrame, archived_at: Column) -> DataFrame:
    retired = superseded(documents).withColumn("retired", F.lit(True))
    return (
        documents.join(retired, "document_id", "left")
        .withColumn("status", F.when(F.col("retired"), "archived").otherwise(F.col("status")))
        .withColumn(
            "archived_at",
            F.when(F.col("retired"), archived_at.cast("timestamp")).otherwise(F.col("archived_at")),
        )
        .select(*documents.columns)
    )


def searchable_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of active documents; every other document loses its chunks."""
    active = documents.filter("status = 'active'").select("document_id")
    return chunks.join(active, "document_id", "left_semi")


def promote(
    documents: DataFrame, chunks: DataFrame, newly_passed: DataFrame, archived_at: Column
) -> tuple[DataFrame, DataFrame]:
    """Activate first, then archive what is covered, then drop chunks of non-active documents."""
    settled = archive_superseded(activate(documents, newly_passed), archived_at)
    return settled, searchable_chunks(chunks, settled)


def chunks_with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Citation view: each chunk with its edition, title, source and status."""
    cited = documents.select("document_id", "edition_year_be", "title_th", "source", "status")
    return chunks.join(cited, "document_id")


def stale_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk counts of non-active documents; must be empty after a promotion."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    gone = documents.filter("status <> 'active'")
    return gone.select("document_id", "edition_year_be", "status").join(counts, "document_id")


def edition_overlap(lines: DataFrame) -> DataFrame:
    """Share of an edition's distinct lines that an older edition already printed.

    ``lines`` has (edition_year_be, text). Lines are hashed and made distinct per edition
    before any comparison, so a line repeated everywhere is one row per edition.
    """
    per_edition = (
        lines.select(
            "edition_year_be", F.explode(split_lines(F.col("text"))).alias("line")
        )
        .filter(~is_blank(F.col("line")))
        .select("edition_year_be", sha256(F.col("line")).alias("line_hash"))
        .distinct()
    )
    first_printed = per_edition.groupBy("line_hash").agg(F.min("edition_year_be").alias("first_year"))
    repeated = F.col("first_year") < F.col("edition_year_be")
    return (
        per_edition.join(first_printed, "line_hash")
        .groupBy("edition_year_be")
        .agg(
            F.count("*").alias("n_lines"),
            F.count_if(repeated).alias("n_repeated"),
        )
        .withColumn("repeated_ratio", F.round(F.col("n_repeated") / F.col("n_lines"), 6))
    )


def corpus_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, content_sha256, n_before, n_after) of hashes whose multiplicity differs.

    A union with two counters needs one shuffle and combines hot hashes map-side.
    """
    key = ["document_id", "content_sha256"]
    old = before.select(*key, F.lit(1).alias("b"), F.lit(0).alias("a"))
    new = after.select(*key, F.lit(0).alias("b"), F.lit(1).alias("a"))
    return (
        old.unionByName(new)
        .groupBy(*key)
        .agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
        .filter(F.col("n_before") != F.col("n_after"))
    )


def document_violations(documents: DataFrame, allowed: list[str] = ALLOWED_SCOPES) -> DataFrame:
    """(constraint, subject) rows for the registry's own constraints."""
    row = F.col("document_id").cast("string")
    scopes = F.coalesce("scopes", F.array().cast("array<string>"))
    per_row = F.array_compact(
        F.array(
            F.when((F.size(scopes) == 0) | (F.size(unknown_scopes(scopes, allowed)) > 0), F.lit("scopes")),
            F.when(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), F.lit("status")),
        )
    )
    rows = documents.select(F.explode(per_row).alias("constraint"), row.alias("subject"))
    hashes = (
        documents.groupBy("file_hash").count().filter("count > 1")
        .select(F.lit("file_hash").alias("constraint"), F.col("file_hash").alias("subject"))
    )
    editions = (
        documents.groupBy("edition_year_be", "source").count().filter("count > 1")
        .select(
            F.lit("edition_source").alias("constraint"),
            F.concat_ws("/", F.col("edition_year_be").cast("string"), "source").alias("subject"),
        )
    )
    return rows.unionByName(hashes).unionByName(editions)


def chunk_violations(chunks: DataFrame, documents: DataFrame, dimension: int) -> DataFrame:
    """(constraint, subject) rows for uniqueness, reference and vector length of chunks."""
    copies = (
        chunks.groupBy("document_id", "content_sha256").count().filter("count > 1")
        .select(
            F.lit("document_content").alias("constraint"),
            F.concat_ws("/", F.col("document_id").cast("string"), "content_sha256").alias("subject"),
        )
    )
    orphans = chunks.join(documents.select("document_id"), "document_id", "left_anti").select(
        F.lit("document_reference").alias("constraint"), F.col("chunk_id").cast("string").alias("subject")
    )
    vectors = chunks.filter(
        F.col("embedding").isNull() | (F.size("embedding") != dimension)
    ).select(F.lit("embedding").alias("constraint"), F.col("chunk_id").cast("string").alias("subject"))
    return copies.unionByName(orphans).unionByName(vectors)


def check_corpus(
    documents: DataFrame, chunks: DataFrame, dimension: int, allowed: list[str] = ALLOWED_SCOPES
) -> DataFrame:
    """Every violated constraint of the corpus, stale chunks included; empty when sound."""
    stale = stale_chunks(chunks, documents).select(
        F.lit("stale_chunks").alias("constraint"), F.col("document_id").cast("string").alias("subject")
    )
    return (
        document_violations(documents, allowed)
        .unionByName(chunk_violations(chunks, documents, dimension))
        .unionByName(stale)
    )
