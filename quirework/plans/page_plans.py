"""Pagination, running lines and page normalisation."""

from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import pages as P
from quirework.plans import fixtures as X
from quirework.plans.catalog import query

# one dropped-line rule after another, per line: the reading the Spark expressions must match
STRIPPED_CTE = X.RUNNING_CTE + """,
edge AS (SELECT document_id, page_number, n FROM filled WHERE a <= 3 OR d <= 3),
kept AS (
  SELECT l.* FROM page_lines l
  LEFT JOIN edge e ON e.document_id = l.document_id AND e.page_number = l.page_number AND e.n = l.n
  LEFT JOIN running r ON r.document_id = l.document_id AND r.running_key = """ + X.sql_key("l.line") + """
  WHERE e.n IS NULL OR r.running_key IS NULL),
stripped AS (
  SELECT p.document_id, p.page_number, coalesce(string_agg(k.line, chr(10) ORDER BY k.n), '') AS text
  FROM doc_pages p LEFT JOIN kept k ON k.document_id = p.document_id AND k.page_number = p.page_number
  GROUP BY 1, 2)"""


def furniture_cte(source: str, column: str) -> str:
    return f""",
f_lines AS (
  SELECT document_id, page_number, regexp_replace(unnest(string_split({column}, chr(10))), '\\s*\\.{{3,}}\\s*[0-9]*\\s*$', '') AS line,
         generate_subscripts(string_split({column}, chr(10)), 1) AS n FROM {source}),
f_filled AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY n) AS a,
         row_number() OVER (PARTITION BY document_id, page_number ORDER BY n DESC) AS d
  FROM f_lines WHERE {X.sql_strip('line')} <> ''),
f_drop AS (
  SELECT document_id, page_number, n FROM f_filled
  WHERE (a = 1 OR d = 1) AND regexp_full_match(line, '\\s*[-_\\[]?\\s*[0-9]+\\s*[-_\\]]?\\s*')),
f_text AS (
  SELECT s.document_id, s.page_number,
         CASE WHEN NOT EXISTS (SELECT 1 FROM f_filled f WHERE f.document_id = s.document_id AND f.page_number = s.page_number)
              THEN any_value(s.{column})
              ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE x.n IS NULL), '') END AS text
  FROM {source} s
  JOIN f_lines l ON l.document_id = s.document_id AND l.page_number = s.page_number
  LEFT JOIN f_drop x ON x.document_id = l.document_id AND x.page_number = l.page_number AND x.n = l.n
  GROUP BY 1, 2)"""


@query("paginate", f"WITH {X.PAGES_CTE} SELECT document_id, page_number, raw_text FROM doc_pages")
def paginate(spark, sf_dir):
    return X.pages(spark, sf_dir).select("document_id", "page_number", "raw_text")


@query(
    "page_counts",
    f"WITH {X.PAGES_CTE} SELECT document_id, count(*) AS n_pages FROM doc_pages GROUP BY 1",
)
def page_counts(spark, sf_dir):
    return P.page_counts(X.pages(spark, sf_dir))


@query(
    "edge_lines",
    f"WITH {X.PAGES_CTE} SELECT document_id, page_number, line FROM filled WHERE a <= 3 "
    "UNION ALL SELECT document_id, page_number, line FROM filled WHERE d <= 3",
)
def edge_lines(spark, sf_dir):
    return P.edge_lines(X.pages(spark, sf_dir)).drop("edge")


@query(
    "outer_lines",
    f"WITH {X.PAGES_CTE} SELECT document_id, page_number, max(line) FILTER (WHERE a = 1) AS first_line, "
    "max(line) FILTER (WHERE d = 1) AS last_line FROM filled GROUP BY 1, 2",
)
def outer_lines(spark, sf_dir):
    return P.outer_lines(X.pages(spark, sf_dir))


@query(
    "running_lines",
    f"WITH {X.RUNNING_CTE} SELECT document_id, running_key, pages_seen, n_pages FROM running",
)
def running_lines(spark, sf_dir):
    return P.running_lines(X.pages(spark, sf_dir))


@query("strip_running_lines", f"WITH {STRIPPED_CTE} SELECT document_id, page_number, text FROM stripped")
def strip_running_lines(spark, sf_dir):
    pages = X.pages(spark, sf_dir)
    keys = P.running_keys_by_document(P.running_lines(pages))
    return pages.join(keys, "document_id", "left").select(
        "document_id",
        "page_number",
        T.strip_running_lines(F.col("raw_text"), F.col("running_keys")).alias("text"),
    )


@query(
    "page_furniture",
    f"WITH {X.PAGES_CTE} {furniture_cte('doc_pages', 'raw_text')} SELECT document_id, page_number, text FROM f_text",
)
def page_furniture(spark, sf_dir):
    return X.pages(spark, sf_dir).select(
        "document_id", "page_number", T.strip_page_furniture(F.col("raw_text")).alias("text")
    )


@query(
    "normalize_pages",
    f"WITH {STRIPPED_CTE} {furniture_cte('stripped', 'text')} SELECT document_id, page_number, "
    f"{X.sql_collapse('text')} AS text FROM f_text",
)
def normalize_pages(spark, sf_dir):
    pages = X.pages(spark, sf_dir)
    return P.normalize_pages(pages, P.running_lines(pages)).select("document_id", "page_number", "text")
