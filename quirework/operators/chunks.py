"""Passages: prose split with overlap, table parts with their section, one copy per document."""

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions import text as T
from quirework.operators import layout, tables as tbl
from quirework.operators.pages import running_keys_by_document

OVERLAP = 150
# Boundaries tried in turn, from paragraph to single character.
SEPARATORS = ("\n\n", "\n", " ", "")

_ORDER = ["page_number", "kind_rank", "position", "part"]


def _cut(text: str, separators: tuple[str, ...], size: int):
    """Yield (piece, mergeable) in order. A separator stays at the front of the piece after
    it; a piece as long as the limit is cut again at the next finer boundary."""
    level = next(i for i, s in enumerate(separators) if s in text)
    separator, finer = separators[level], separators[level + 1 :]
    if separator == "":
        pieces = list(text)
    else:
        first, *rest = text.split(separator)
        pieces = [first, *(separator + r for r in rest)]
    run = []
    for piece in pieces:
        if not piece:
            continue
        if len(piece) < size or not finer:
            run.append(piece)
            continue
        yield run
        run = []
        yield from _cut(piece, finer, size)
    yield run


def split_text(text: str, max_chars: int = tbl.MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most ``max_chars`` characters; neighbours share up to ``overlap``."""
    chunks = []

    def emit(window):
        chunk = "".join(window).strip()
        if chunk:
            chunks.append(chunk)

    for run in _cut(text, SEPARATORS, max_chars):
        window, used = deque(), 0
        for piece in run:
            if window and used + len(piece) > max_chars:
                emit(window)
                while window and (used > overlap or used + len(piece) > max_chars):
                    used -= len(window.popleft())
            window.append(piece)
            used += len(piece)
        emit(window)
    return chunks


def split_prose(text: Column, max_chars: int = tbl.MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Array of chunks. Text within the limit never leaves the JVM."""

    @F.pandas_udf("array<string>")
    def cut_long(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: split_text(s, max_chars, overlap), na_action="ignore")

    short = F.length(text) < max_chars
    whole = F.filter(F.array(T.strip(text)), lambda s: s != "")
    return F.when(short, whole).otherwise(cut_long(F.when(~short, text)))


def keep_first_copies(chunks: DataFrame, order: list[str], content: str = "content_sha256") -> DataFrame:
    """First occurrence of each content, given as itself or its hash, within a document.

    A rank limit on a window is applied before the shuffle as well as after it, so a
    passage repeated on most rows leaves one row per task.
    """
    first = Window.partitionBy("document_id", content).orderBy(*order)
    return (
        chunks.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") == 1).drop("copy")
    )


def chunk_id(document_id: Column, content_sha256: Column) -> Column:
    """Deterministic id, so a retried task writes the same row."""
    return F.sha2(F.concat_ws("/", document_id.cast("string"), content_sha256), 256)


def chunk_documents(
    blocks: DataFrame,
    tables: DataFrame,
    running: DataFrame,
    max_chars: int = tbl.MAX_CHARS,
    overlap: int = OVERLAP,
    heading: str = layout.HEADING,
    strict: bool = False,
) -> DataFrame:
    """Passages of every document: per page its prose, then its tables from top to bottom.

    Tables on a page without any block are skipped.
    """
    page = ["document_id", "page_number"]
    # a table without a page has no block beside it; said here, both readers of the tables share one exchange
    tables = tables.filter(F.col("document_id").isNotNull() & F.col("page_number").isNotNull())
    prose = (
        layout.prose_text(blocks, tables)
        .join(running_keys_by_document(running), "document_id", "left")
        .withColumn("text", T.normalize_page(F.col("prose"), F.col("running_keys"), strict))
        .select(*page, F.posexplode(split_prose(F.col("text"), max_chars, overlap)).alias("part", "content"))
        .select(
            *page,
            F.lit(0).alias("kind_rank"),
            F.lit(0).alias("position"),
            "part",
            F.lit(None).cast("string").alias("section"),
            "content",
        )
        .filter(~T.is_blank(F.col("content")))
    )
    # a table crosses the shuffles as its markdown alone, which is normalised once and split by its column
    rendered = tables.select(*page, "ordinal", "bbox", "markdown")
    parts = tbl.split_table(F.col("normalized"), max_chars)
    tabular = (
        layout.section_for_tables(rendered, blocks, heading)
        .join(blocks.select(*page).distinct(), page, "left_semi")
        .withColumn("normalized", T.normalize_table(F.col("markdown"), strict))
        .select(*page, "position", "section", F.posexplode(parts).alias("part", "content"))
        .select(
            *page,
            F.lit(1).alias("kind_rank"),
            "position",
            "part",
            "section",
            "content",
        )
    )
    # passages are compared as they are; hash, id and kind follow from what crossed the shuffle
    unique = keep_first_copies(prose.unionByName(tabular), _ORDER, "content").select(
        "*",
        T.sha256(F.col("content")).alias("content_sha256"),
        F.when(F.col("kind_rank") == 0, "prose").otherwise("table").alias("kind"),
    )
    return unique.select(
        chunk_id(F.col("document_id"), F.col("content_sha256")).alias("chunk_id"),
        "document_id",
        *_ORDER,
        "section",
        "kind",
        "content",
        "content_sha256",
    )


def embed_chunks(chunks: DataFrame, embedder, dimension: int) -> DataFrame:
    """Add ``tokens``, which searches read, and the ``embedding`` made from them; a vector of
    another length fails the job."""
    vector = F.col("embedding")
    wrong = vector.isNull() | (F.size(vector) != dimension)
    return (
        chunks.withColumn("tokens", T.tokenize(F.col("content")))
        .withColumn("embedding", embedder(F.col("tokens")))
        .withColumn(
            "embedding",
            F.when(
                wrong,
                F.raise_error(
                    F.concat(F.lit(f"expected {dimension} dimensions, got "), F.size(vector).cast("string"))
                ).cast("array<float>"),
            ).otherwise(vector),
        )
    )


def pair_by_position(chunks: DataFrame, embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a strict positional join that lack a partner; empty when the lists agree."""
    left = chunks.select(*keys, F.lit(True).alias("has_chunk"))
    right = embeddings.select(*keys, F.lit(True).alias("has_embedding"))
    both = left.join(right, keys, "full_outer")
    return both.filter(F.col("has_chunk").isNull() | F.col("has_embedding").isNull()).select(
        *keys,
        F.when(F.col("has_chunk").isNull(), "no chunk").otherwise("no embedding").alias("violation"),
    )
