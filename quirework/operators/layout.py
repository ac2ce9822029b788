"""Page geometry: text outside tables, and the heading printed above a table."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions.text import strip

# Fixed value: a crop heading is Thai words followed by a Latin name in parentheses.
HEADING = "(?U)^[\u0e01-\u0e5b\\s]+\\([A-Za-z][A-Za-z\\s,'\\-\\.]*\\)"

BAND_HEIGHT = 64.0
_PAGE = ["document_id", "page_number"]


def by_page(rows: DataFrame) -> DataFrame:
    """Rows dealt by page, once: joins on the page, and windows and groupings within it, move none of them again."""
    return rows.repartition(*_PAGE)


def overlaps(a: Column, b: Column) -> Column:
    """True when two rectangles share area; touching edges do not count."""
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def _bands(bbox: Column, height: float) -> Column:
    low, high = F.least(bbox["y0"], bbox["y1"]), F.greatest(bbox["y0"], bbox["y1"])
    return F.sequence(F.floor(low / height), F.floor(high / height))


def blocks_inside_tables(
    blocks: DataFrame, tables: DataFrame, band_height: float = BAND_HEIGHT
) -> DataFrame:
    """Keys (document_id, page_number, ordinal) of blocks that overlap a table on their page.

    Two rectangles that share area share a horizontal band, so the band joins the equality
    keys: the join stays a hash or merge join, and a crowded page is split by band.
    """
    probe = blocks.select(*_PAGE, "ordinal", "bbox", F.explode(_bands(F.col("bbox"), band_height)).alias("band"))
    build = tables.select(
        *_PAGE, F.col("bbox").alias("table_bbox"), F.explode(_bands(F.col("bbox"), band_height)).alias("band")
    )
    same_band = [probe[c] == build[c] for c in (*_PAGE, "band")]
    hit = probe.join(
        build, [*same_band, overlaps(probe["bbox"], build["table_bbox"])], "left_semi"
    )
    return hit.select(*_PAGE, "ordinal").distinct()


def prose_blocks(blocks: DataFrame, tables: DataFrame, band_height: float = BAND_HEIGHT) -> DataFrame:
    return blocks.join(
        blocks_inside_tables(blocks, tables, band_height), [*_PAGE, "ordinal"], "left_anti"
    )


def prose_text(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per page that has blocks: the text outside its tables in reading order.

    Blocks and tables meet by page, where a page's blocks are gathered anyway: each is moved once, as it is.
    A block inside a table takes along the blocks of its page that have its ordinal; one without an ordinal stays.
    """
    corners = ["x0", "y0", "x1", "y1"]

    def named(side: str, rows: DataFrame, *columns: str) -> DataFrame:
        """Names of its own for either side, and corners as plain columns: a page's pairs only compare numbers."""
        return by_page(rows).select(
            *[F.col(c).alias(f"{side}_{c}") for c in (*_PAGE, *columns)], *[F.col(f"bbox.{c}").alias(f"{side}_{c}") for c in corners]
        )

    block = {c: F.col(f"block_{c}").outer() for c in (*_PAGE, *corners)}
    table = {c: F.col(f"table_{c}") for c in (*_PAGE, *corners)}
    covering = named("table", tables).where(reduce(and_, [table[c] == block[c] for c in _PAGE]) & overlaps(block, table))
    line = F.struct(F.col("block_y0").alias("y0"), F.col("block_ordinal").alias("ordinal"), F.col("block_text").alias("text"))
    outside = F.filter("lines", lambda b: ~F.coalesce(F.array_contains("covered", b["ordinal"]), F.lit(False)))
    return (
        named("block", blocks, "ordinal", "text")
        .withColumn("inside", covering.exists())
        .withColumn("inside", F.col("inside") & F.col("block_ordinal").isNotNull())
        .groupBy(*[F.col(f"block_{c}").alias(c) for c in _PAGE])
        .agg(
            F.collect_list(F.when(~F.col("inside"), line)).alias("lines"),
            F.collect_set(F.when(F.col("inside"), F.col("block_ordinal"))).alias("covered"),
        )
        .select(*_PAGE, F.array_join(F.transform(F.array_sort(outside), lambda b: b["text"]), "\n").alias("prose"))
    )


def headings(blocks: DataFrame, pattern: str = HEADING) -> DataFrame:
    """Blocks whose first line is a heading, with that line as ``section``."""
    first_line = strip(F.substring_index("text", "\n", 1))
    return blocks.withColumn("section", first_line).filter(F.col("section").rlike(pattern))


def section_for_tables(tables: DataFrame, blocks: DataFrame, pattern: str = HEADING) -> DataFrame:
    """Add ``section``: the nearest heading that ends at or above the table on the same page; and
    ``position``: the table's place from the top of its page.

    An as-of join as one sort: headings and tables of a page are merged by height and the
    last heading is carried forward, so no heading-table pairs are formed.
    """
    above = headings(blocks, pattern).select(
        *_PAGE,
        F.col("bbox.y1").alias("at"),
        F.lit(0).alias("rank"),
        (-F.col("ordinal")).alias("tie"),
        "section",
    )
    below = tables.select(
        *_PAGE,
        F.col("bbox.y0").alias("at"),
        F.lit(1).alias("rank"),
        F.col("ordinal").alias("tie"),
        F.struct(*[c for c in tables.columns if c not in _PAGE]).alias("table"),
    )
    down_the_page = (
        Window.partitionBy(*_PAGE).orderBy("at", "rank", "tie").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        by_page(above)
        .unionByName(by_page(below), allowMissingColumns=True)
        .withColumn("section", F.last("section", ignorenulls=True).over(down_the_page))
        .withColumn("position", F.sum("rank").over(down_the_page).cast("int"))
        .filter(F.col("rank") == 1)
        .select(*_PAGE, "table.*", "section", "position")
    )


def table_character_share(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Share of a document's block characters that lie inside tables."""
    inside = blocks_inside_tables(blocks, tables).withColumn("inside", F.lit(True))
    length = F.length("text")
    return (
        blocks.join(inside, [*_PAGE, "ordinal"], "left")
        .groupBy("document_id")
        .agg(
            F.sum(length).alias("n_chars"),
            F.sum(F.when(F.col("inside"), length).otherwise(0)).alias("table_chars"),
        )
        .withColumn(
            "table_share",
            F.when(F.col("n_chars") > 0, F.round(F.col("table_chars") / F.col("n_chars"), 6)),
        )
    )
