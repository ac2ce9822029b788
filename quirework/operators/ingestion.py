"""The whole ingest path for a batch of admitted documents."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quirework.functions.common import materialize
from quirework.operators import chunks as C, pages as P, quality as Q, refusals as R, registry as G, supersede as S


@dataclass
class Ingested:
    """What a batch changes: the registry after it, the registry rows that are new or different, the passages
    that become searchable, the documents whose earlier passages go, and the gate's record."""

    documents: DataFrame
    changed: DataFrame
    chunks: DataFrame
    removed: DataFrame
    qa: DataFrame


def ingest_changes(
    files: DataFrame,
    pages: DataFrame,
    blocks: DataFrame,
    tables: DataFrame,
    registry: DataFrame,
    embedder,
    dimension: int,
    model: str,
    at: Column,
    parser: str = "spark",
    chunk_options: dict | None = None,
    gate_options: dict | None = None,
    running_options: dict | None = None,
) -> Ingested:
    """Admission, gate, chunking, embedding and promotion of a batch; stored passages are not read.

    ``files`` has document_id, source, title_th, edition_year_be, scopes, file_hash and
    page_count. Files whose hash is active or archived are refused; a hash that is still
    pending keeps the document_id it is stored under, whatever id the caller gives it. A
    failing document stays pending with its record and has no chunks; codes without a repair in
    blocks or tables fail it as those on pages do. Editions are settled before anything is embedded, so
    passages that a newer edition of the same batch archives are counted but cost no call of the model.
    Steps used more than once are written to the shared folder, so the gate runs once and each passage
    that becomes searchable is embedded once.
    """
    unique = G.first_of_each_hash(files, "document_id")
    stored = registry.select("file_hash", "status", F.col("document_id").alias("stored_id"))
    decided = (
        unique.withColumnRenamed("document_id", "given_id")
        .join(stored, "file_hash", "left")
        .withColumn("action", G.admission_action(F.col("status")))
        .withColumn("document_id", F.coalesce("stored_id", "given_id"))
    )
    admitted = materialize(decided.filter(F.col("action") != "refuse"), "admitted")
    ids = admitted.select("given_id", F.col("document_id").alias("kept_id"))

    def of_admitted(rows: DataFrame) -> DataFrame:
        """Rows of admitted files, under the ids that the registry has."""
        return (
            rows.join(ids, rows["document_id"] == ids["given_id"])
            .withColumn("document_id", F.col("kept_id"))
            .select(*rows.columns)
        )

    pages, blocks, tables = of_admitted(pages), of_admitted(blocks), of_admitted(tables)
    gate = Q.qa_gate(
        pages,
        admitted.select("document_id", "page_count", "scopes"),
        tables,
        **(gate_options or {}),
    )
    texts = blocks.select("document_id", "text").union(tables.select("document_id", "markdown"))
    qa = materialize(R.block_unmapped(gate, R.unmapped_codes(texts, "document_id", ["text"])), "qa")
    inserted = G.pending_rows(admitted.filter("action = 'insert'"), qa, at, parser)
    documents = G.overwrite_qa(registry, qa).unionByName(inserted)

    passed = Q.passed_documents(admitted.select("document_id"), qa)
    passages = C.chunk_documents(
        blocks.join(passed, "document_id", "left_semi"),
        tables.join(passed, "document_id", "left_semi"),
        P.running_lines(pages.join(passed, "document_id", "left_semi"), **(running_options or {})),
        **(chunk_options or {}),
    )
    cut = materialize(passages, "passages")
    counted = G.chunk_statistics(documents, passed, cut, model)
    settled = materialize(S.archive_superseded(S.activate(counted, passed), at), "documents")

    before = registry.select("document_id", F.col("status").alias("status_before"))
    touched = admitted.select("document_id", F.lit(True).alias("touched"))
    differs = F.col("touched") | F.col("status_before").isNull() | (F.col("status") != F.col("status_before"))
    changed = materialize(
        settled.join(before, "document_id", "left").join(touched, "document_id", "left").filter(differs).select(*settled.columns),
        "changed",
    )
    new_chunks = materialize(C.embed_chunks(S.searchable_chunks(cut, changed), embedder, dimension), "chunks")
    return Ingested(settled, changed, new_chunks, changed.select("document_id"), qa)


def ingest(
    files: DataFrame,
    pages: DataFrame,
    blocks: DataFrame,
    tables: DataFrame,
    registry: DataFrame,
    stored_chunks: DataFrame,
    embedder,
    dimension: int,
    model: str,
    at: Column,
    **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, qa): the whole registry and passage table after ``ingest_changes``."""
    done = ingest_changes(files, pages, blocks, tables, registry, embedder, dimension, model, at, **options)
    left = stored_chunks.join(done.removed, "document_id", "left_anti")
    return done.documents, S.searchable_chunks(left.unionByName(done.chunks), done.documents), done.qa
