"""Parse-quality gate: every check runs on every document, failing ones produce no chunks."""

from pyspark.sql import Column, DataFrame, functions as F

from quirework.functions import text as T

# Character classes of the script checks and the default thresholds.
THAI_COMBINING = "[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]"
THAI_CONSONANT = "[\u0e01-\u0e2e]"
EMPTY_RATIO_MAX = 0.5
COMBINING_RATIO_MIN = 0.20
THIN_PAGE_CHARS = 50


def measure_pages(
    pages: DataFrame,
    combining: str = THAI_COMBINING,
    consonant: str = THAI_CONSONANT,
    thin_page_chars: int = THIN_PAGE_CHARS,
) -> DataFrame:
    """One row of page measurements per document.

    Counts are partial sums before the shuffle; of the page numbers only those are gathered that
    differ from the page's ordinal, its place in the document. Codepoint labels are exploded only for
    pages that hold such characters and are made distinct map-side.
    """
    raw = F.col("raw_text")
    n_chars = F.length(T.strip(raw))
    misplaced = F.struct(F.col("ordinal").cast("int").alias("position"), F.col("page_number").cast("int").alias("page_number"))
    counts = pages.groupBy("document_id").agg(
        F.count("*").alias("n_pages"),
        F.array_sort(F.collect_list(F.when(~F.col("ordinal").eqNullSafe(F.col("page_number")), misplaced))).alias("misnumbered"),
        F.count_if(n_chars == 0).alias("n_empty"),
        F.count_if(n_chars < thin_page_chars).alias("n_thin"),
        F.sum(F.regexp_count(raw, F.lit(combining)).cast("long")).alias("n_combining"),
        F.sum(T.count_characters(raw, consonant).cast("long")).alias("n_consonants"),
    )
    private = (
        pages.select(
            "document_id",
            F.explode(
                F.array_distinct(F.regexp_extract_all(raw, F.lit(T.ANY_PUA), F.lit(0)))
            ).alias("char"),
        )
        .distinct()
        .groupBy("document_id")
        .agg(
            F.array_sort(
                F.collect_set(
                    F.when(F.col("char").rlike(T.UNMAPPED_THAI_PUA), T.codepoint_label(F.col("char")))
                )
            ).alias("unmapped"),
            F.array_sort(
                F.collect_set(
                    F.when(F.col("char").rlike(T.SYMBOL_PUA), T.codepoint_label(F.col("char")))
                )
            ).alias("symbols"),
        )
    )
    nothing = F.array().cast("array<string>")
    return counts.join(private, "document_id", "left").select(
        *counts.columns,
        F.coalesce("unmapped", nothing).alias("unmapped"),
        F.coalesce("symbols", nothing).alias("symbols"),
    )


def _ratio(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.4f", F.round(value, 4)))


def qa_gate(
    pages: DataFrame,
    documents: DataFrame,
    tables: DataFrame | None = None,
    empty_ratio_max: float = EMPTY_RATIO_MAX,
    combining_ratio_min: float = COMBINING_RATIO_MIN,
    thin_page_chars: int = THIN_PAGE_CHARS,
    combining: str = THAI_COMBINING,
    consonant: str = THAI_CONSONANT,
) -> DataFrame:
    """(document_id, check, passed, measured, threshold) for every document and check.

    ``documents`` gives document_id, page_count and scopes; ``measured`` is JSON text.
    Page order is the source ordinal 1..n, unique within a document. Without a table
    frame ``tables_found`` is null, which is not the same as zero.
    """
    measured = measure_pages(pages, combining, consonant, thin_page_chars)
    facts = documents.select("document_id", "page_count", "scopes").join(
        measured, "document_id", "left"
    )
    if tables is None:
        facts = facts.withColumn("n_tables", F.lit(None).cast("long"))
    else:
        found = tables.groupBy("document_id").agg(F.count("*").alias("n_tables"))
        facts = facts.join(found, "document_id", "left").withColumn(
            "n_tables", F.coalesce("n_tables", F.lit(0))
        )

    n_pages = F.coalesce("n_pages", F.lit(0))
    empty_ratio = F.when(n_pages > 0, F.col("n_empty") / n_pages).otherwise(F.lit(1.0))
    consonants = F.coalesce("n_consonants", F.lit(0))
    ratio = F.when(consonants > 0, F.col("n_combining") / consonants)
    nothing = F.array().cast("array<string>")
    no_pages = F.array().cast("array<struct<position:int,page_number:int>>")
    unmapped, symbols = F.coalesce("unmapped", nothing), F.coalesce("symbols", nothing)
    scopes = F.coalesce("scopes", nothing)
    always = F.lit(True)

    checks = [
        (
            "page_numbers_not_sequential",
            F.coalesce(F.size("misnumbered"), F.lit(0)) <= 0,
            F.to_json(F.struct(n_pages.alias("pages"), F.coalesce("misnumbered", no_pages).alias("misnumbered"))),
            None,
        ),
        ("page_count_mismatch", n_pages == F.col("page_count"), n_pages, F.col("page_count")),
        ("empty_ratio_too_high", empty_ratio <= empty_ratio_max, _ratio(empty_ratio), empty_ratio_max),
        ("thin_pages", always, F.coalesce("n_thin", F.lit(0)), thin_page_chars),
        ("unmapped_pua_codepoints", F.size(unmapped) == 0, F.to_json(unmapped), None),
        ("symbol_pua_codepoints", always, F.to_json(symbols), None),
        (
            "combining_ratio_too_low",
            F.coalesce(ratio >= combining_ratio_min, F.lit(True)),
            _ratio(ratio),
            combining_ratio_min,
        ),
        ("no_thai_consonants", consonants > 0, consonants, None),
        ("tables_found", always, F.col("n_tables"), None),
        ("scopes_empty", F.size(scopes) > 0, F.to_json(scopes), None),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                passed.alias("passed"),
                value.cast("string").alias("measured"),
                (limit if isinstance(limit, Column) else F.lit(limit)).cast("double").alias("threshold"),
            )
            for name, passed, value, limit in checks
        ]
    )
    return facts.select("document_id", F.inline(rows))


def failed_checks(qa: DataFrame) -> DataFrame:
    """Documents that fail, with the sorted names of the checks (at most ten)."""
    return (
        qa.filter(~F.col("passed"))
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_set("check")).alias("failed_checks"))
    )


def qa_record(qa: DataFrame) -> DataFrame:
    """The stored form: one map from check to its result per document."""
    entry = F.struct(
        "check",
        F.struct("passed", "measured", "threshold").alias("result"),
    )
    return qa.groupBy("document_id").agg(F.map_from_entries(F.collect_list(entry)).alias("qa"))


def passed_documents(documents: DataFrame, qa: DataFrame) -> DataFrame:
    failing = qa.filter(~F.col("passed")).select("document_id").distinct()
    return documents.join(failing, "document_id", "left_anti")
