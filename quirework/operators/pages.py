"""Pages of a document: pagination, running headers and footers, page normalisation."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quirework.functions import text as T
from quirework.functions.common import let


def paginate(documents: DataFrame, lines_per_page: int, keep: Sequence[str] = ()) -> DataFrame:
    """Cut ``text`` into pages of a fixed number of lines, within each row.

    Returns (document_id, ordinal, page_number, raw_text), ordinal and number from 1, and the columns of ``keep``.
    """
    pages = let(
        T.split_lines(F.col("text")),
        lambda lines: F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(lines) / lines_per_page).cast("int") - 1),
            lambda p: F.array_join(F.slice(lines, p * lines_per_page + 1, lines_per_page), "\n"),
        ),
    )
    return documents.select("document_id", *keep, F.posexplode(pages).alias("pos", "raw_text")).select(
        "document_id",
        (F.col("pos") + 1).alias("ordinal"),
        (F.col("pos") + 1).alias("page_number"),
        "raw_text",
        *keep,
    )


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count("*").alias("n_pages"))


def edge_lines(pages: DataFrame) -> DataFrame:
    """One row per edge line of a page, in page order."""
    return pages.select(
        "document_id",
        "page_number",
        F.posexplode(T.edge_lines(F.col("raw_text"))).alias("edge", "line"),
    )


def running_lines(
    pages: DataFrame, min_page_ratio: float = 0.5, min_pages: int = 1
) -> DataFrame:
    """Keys of edge lines seen on at least ``min_page_ratio`` of a document's pages.

    Keys are made distinct inside the page row, so the count needs one shuffle and is
    combined map-side even when one document holds most pages.
    """
    seen = (
        pages.select("document_id", F.explode(T.edge_keys(F.col("raw_text"))).alias("running_key"))
        .groupBy("document_id", "running_key")
        .agg(F.count("*").alias("pages_seen"))
    )
    return (
        seen.join(page_counts(pages), "document_id")
        .filter(F.col("n_pages") >= min_pages)
        .filter(F.col("pages_seen") >= F.col("n_pages") * F.lit(min_page_ratio))
    )


def running_keys_by_document(running: DataFrame) -> DataFrame:
    """At most 6 / min_page_ratio keys qualify per document, so the set is small."""
    return running.groupBy("document_id").agg(
        F.array_sort(F.collect_set("running_key")).alias("running_keys")
    )


def normalize_pages(pages: DataFrame, running: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``text``: the page after all five normalisation steps."""
    keyed = pages.join(running_keys_by_document(running), "document_id", "left")
    return keyed.withColumn(
        "text", T.normalize_page(F.col("raw_text"), F.col("running_keys"), strict)
    ).drop("running_keys")


def survey_pua(pages: DataFrame) -> DataFrame:
    """Occurrences of each private-use tone-mark code over the corpus."""
    found = F.regexp_extract_all("raw_text", F.lit(T.THAI_PUA), F.lit(0))
    return (
        pages.select(F.explode(found).alias("char"))
        .groupBy("char")
        .agg(F.count("*").alias("occurrences"))
        .select(
            T.codepoint_label(F.col("char")).alias("codepoint"),
            "occurrences",
            F.col("char").isin(list(T.PUA_TO_THAI)).alias("mapped"),
        )
    )


def outer_lines(pages: DataFrame) -> DataFrame:
    """First and last non-blank line of each page that has one."""
    filled = F.filter(T.split_lines(F.col("raw_text")), lambda line: ~T.is_blank(line))
    return pages.select(
        "document_id",
        "page_number",
        F.inline(
            let(
                filled,
                lambda f: F.filter(
                    F.array(F.struct(F.get(f, 0).alias("first_line"), F.get(f, F.size(f) - 1).alias("last_line"))),
                    lambda s: s["first_line"].isNotNull(),
                ),
            )
        ),
    )
