"""The passage table as a log of deltas: writes replace documents, reads see the newest generation."""

from pyspark.sql import DataFrame, SparkSession

from quirework.sources import versions as V

TABLE = "chunks"


def write_chunks(
    chunks: DataFrame, replaced: DataFrame, root: str, source: str | None = None, batch: int | None = None
) -> int:
    """Replace the chunks of the ``replaced`` documents (document_id), and of those that ``chunks``
    brings, by ``chunks``; the new generation's number.

    Only the new rows and the replaced ids are written, so the bytes follow the batch and not the table.
    """
    gone = replaced.select("document_id").union(chunks.select("document_id")).distinct()
    return V.publish(chunks.sparkSession, root, {TABLE: V.Change(chunks, gone)}, source, batch)


def read_chunks(spark: SparkSession, root: str, schema: str, generation: int | None = None) -> DataFrame:
    return V.read(spark, root, TABLE, schema, generation=generation)
