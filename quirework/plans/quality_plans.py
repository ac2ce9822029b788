"""The parse-quality gate, check by check and as a whole."""

from pyspark.sql import functions as F

from quirework.operators import quality as Q
from quirework.plans import fixtures as X
from quirework.plans.catalog import query

# page numbers slip on some documents, a page of some is blank, letters become private-use codes
_PAGES = f"""
qa_pages AS (
  SELECT document_id, page_number AS ordinal,
         CAST(CASE WHEN document_id % 9 = 4 AND page_number > 1 THEN page_number + 1 ELSE page_number END AS INTEGER) AS page_number,
         CASE WHEN (document_id + page_number) % 4 = 0 THEN ' ' || chr(10)
              WHEN document_id % 6 = 1 THEN {X.PUA_SQL.format(x='raw_text')} ELSE raw_text END AS raw_text
  FROM doc_pages)"""

_FACTS = f"""WITH {X.PAGES_CTE}, {X.REGISTRY_CTE}, {_PAGES},
m AS (
  SELECT document_id, count(*) AS n_pages,
         list('{{"position":' || place || ',"page_number":' || page_number || '}}' ORDER BY place) FILTER (WHERE page_number <> place) AS misnumbered,
         count_if({X.sql_strip('raw_text')} = '') AS n_empty,
         count_if(len({X.sql_strip('raw_text')}) < 50) AS n_thin,
         sum(len(regexp_extract_all(raw_text, '{X.VOWEL_MARKS}'))) AS marks,
         sum(len(regexp_extract_all(raw_text, '{X.CONSONANTS}'))) AS consonants,
         count_if(contains(raw_text, chr(63239))) AS unmapped, count_if(contains(raw_text, chr(61537))) AS symbols
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal) AS place FROM qa_pages) GROUP BY 1),
f AS (
  SELECT r.document_id, r.page_count - CASE WHEN r.document_id % 13 = 5 THEN 1 ELSE 0 END AS page_count,
         CASE WHEN r.document_id % 17 = 3 THEN [] ELSE r.scopes END AS scopes, m.*,
         CASE WHEN contains(r.text, ' | ') THEN 1 ELSE 0 END AS n_tables
  FROM registry r JOIN m ON m.document_id = r.document_id)"""

_CHECKS = {
    "page_numbers_not_sequential": (
        "misnumbered IS NULL",
        "'{\"pages\":' || n_pages || ',\"misnumbered\":[' || coalesce(array_to_string(misnumbered, ','), '') || ']}'",
        "NULL",
    ),
    "page_count_mismatch": ("n_pages = page_count", "CAST(n_pages AS VARCHAR)", "page_count"),
    "empty_ratio_too_high": (
        "n_empty / n_pages <= 0.5", "printf('%.4f', round(n_empty / n_pages, 4))", "0.5"
    ),
    "thin_pages": ("true", "CAST(n_thin AS VARCHAR)", "50"),
    "unmapped_pua_codepoints": (
        "unmapped = 0", "CASE WHEN unmapped > 0 THEN '[\"U+F707\"]' ELSE '[]' END", "NULL"
    ),
    "symbol_pua_codepoints": ("true", "CASE WHEN symbols > 0 THEN '[\"U+F061\"]' ELSE '[]' END", "NULL"),
    "combining_ratio_too_low": (
        "consonants = 0 OR marks / consonants >= 0.02",
        "CASE WHEN consonants > 0 THEN printf('%.4f', round(marks / consonants, 4)) END",
        "0.02",
    ),
    "no_thai_consonants": ("consonants > 0", "CAST(consonants AS VARCHAR)", "NULL"),
    "tables_found": ("true", "CAST(n_tables AS VARCHAR)", "NULL"),
    "scopes_empty": (
        "len(scopes) > 0",
        "CASE WHEN len(scopes) = 0 THEN '[]' ELSE '[\"' || array_to_string(scopes, '\",\"') || '\"]' END",
        "NULL",
    ),
}


def _check_sql(name: str) -> str:
    passed, measured, threshold = _CHECKS[name]
    return (
        f"SELECT document_id, '{name}' AS \"check\", ({passed}) AS passed, {measured} AS measured, "
        f"CAST({threshold} AS DOUBLE) AS threshold FROM f"
    )


_ALL = " UNION ALL ".join(_check_sql(name) for name in _CHECKS)


def qa_inputs(spark, sf_dir):
    key, number = F.col("document_id"), F.col("page_number")
    pages = X.pages(spark, sf_dir)
    letters, codes = "éèóñäí", "\uf70a\uf710\uf707\uf718\uf061\uf71a"
    pages = pages.withColumn(
        "raw_text",
        F.when((key + number) % 4 == 0, " \n")
        .when(key % 6 == 1, F.translate("raw_text", letters, codes))
        .otherwise(F.col("raw_text")),
    ).withColumn("page_number", F.when((key % 9 == 4) & (number > 1), number + 1).otherwise(number))
    registry = X.registry(spark, sf_dir)
    documents = registry.select(
        "document_id",
        (F.col("page_count") - F.when(key % 13 == 5, 1).otherwise(0)).alias("page_count"),
        F.when(key % 17 == 3, F.array().cast("array<string>")).otherwise(F.col("scopes")).alias("scopes"),
    )
    tables = registry.filter(F.contains("text", F.lit(" | "))).select("document_id")
    return pages, documents, tables


def gate(spark, sf_dir):
    pages, documents, tables = qa_inputs(spark, sf_dir)
    return Q.qa_gate(
        pages, documents, tables, combining_ratio_min=0.02, combining=X.VOWEL_MARKS, consonant=X.CONSONANTS
    )


query("qa_gate", f"{_FACTS} {_ALL}")(gate)


def _register(name: str) -> None:
    @query(f"qa_{name}", f"{_FACTS} {_check_sql(name)}")
    def one_check(spark, sf_dir):
        return gate(spark, sf_dir).filter(F.col("check") == name)


for _name in _CHECKS:
    _register(_name)


@query(
    "qa_failed_checks",
    f"{_FACTS}, q AS ({_ALL}) SELECT document_id, string_agg(\"check\", ',' ORDER BY \"check\") AS failed_checks "
    "FROM q WHERE NOT passed GROUP BY 1",
)
def qa_failed_checks(spark, sf_dir):
    return Q.failed_checks(gate(spark, sf_dir)).withColumn(
        "failed_checks", F.array_join("failed_checks", ",")
    )


@query(
    "qa_passed_documents",
    f"{_FACTS}, q AS ({_ALL}) SELECT document_id FROM q GROUP BY 1 HAVING bool_and(passed)",
)
def qa_passed_documents(spark, sf_dir):
    _, documents, _ = qa_inputs(spark, sf_dir)
    return Q.passed_documents(documents, gate(spark, sf_dir)).select("document_id")


@query(
    "qa_record",
    f"{_FACTS}, q AS ({_ALL}) SELECT document_id, count(*) AS n_checks, CAST(count_if(passed) AS BIGINT) AS n_passed, "
    "max(measured) FILTER (WHERE \"check\" = 'thin_pages') AS thin_pages FROM q GROUP BY 1",
)
def qa_record(spark, sf_dir):
    record = Q.qa_record(gate(spark, sf_dir))
    return record.select(
        "document_id",
        F.size("qa").cast("bigint").alias("n_checks"),
        F.size(F.map_filter("qa", lambda _, r: r["passed"])).cast("bigint").alias("n_passed"),
        F.col("qa")["thin_pages"]["measured"].alias("thin_pages"),
    )
