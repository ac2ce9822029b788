"""Cell grids, table parts, page geometry and passages."""

from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import chunks as C, layout as L, pages as P, tables as B
from quirework.plans import fixtures as X
from quirework.plans.catalog import query

_MAX = 300

# the empty first column is dropped, an empty row is dropped, short rows are padded
_MARKDOWN = f"""
grid_rows AS (
  SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS r FROM documents),
grid AS (
  SELECT document_id, r, generate_subscripts(string_split(line, ','), 1) AS c,
         trim(regexp_replace(replace(unnest(string_split(line, ',')), '|', chr(92) || '|'), '\\s+', ' ', 'g')) AS cell
  FROM grid_rows),
kept_columns AS (SELECT DISTINCT document_id, c FROM grid WHERE cell <> ''),
kept_rows AS (
  SELECT document_id, r, row_number() OVER (PARTITION BY document_id ORDER BY r) AS k
  FROM (SELECT DISTINCT document_id, r FROM grid WHERE cell <> '')),
rendered AS (
  SELECT kr.document_id, kr.k, '|' || string_agg(coalesce(g.cell, ''), '|' ORDER BY kc.c) || '|' AS line,
         '|' || string_agg('---', '|') || '|' AS rule
  FROM kept_rows kr JOIN kept_columns kc USING (document_id)
  LEFT JOIN grid g ON g.document_id = kr.document_id AND g.r = kr.r AND g.c = kc.c
  GROUP BY 1, 2),
markdown AS (
  SELECT d.doc_id AS document_id,
         coalesce(string_agg(CASE WHEN k = 1 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY k), '') AS markdown
  FROM documents d LEFT JOIN rendered ON document_id = doc_id GROUP BY 1)"""

MARKDOWN_CTE = _MARKDOWN


def parts_cte(size: int) -> str:
    """Parts of every document's grid; rows are walked one by one, carrying the part number and the characters used in it."""
    return f"""{_MARKDOWN},
heads AS (
  SELECT document_id, markdown, string_split(markdown, chr(10)) AS lines,
         {size} - len(string_split(markdown, chr(10))[1]) - len(string_split(markdown, chr(10))[2]) - 2 AS budget
  FROM markdown WHERE len(markdown) > {size}),
walk AS (
  SELECT document_id, 3 AS i, 1 AS part, len(lines[3]) + 1 AS used FROM heads WHERE len(lines) >= 3
  UNION ALL
  SELECT w.document_id, w.i + 1,
         CASE WHEN w.used + len(h.lines[w.i + 1]) > h.budget THEN w.part + 1 ELSE w.part END,
         CASE WHEN w.used + len(h.lines[w.i + 1]) > h.budget THEN len(h.lines[w.i + 1]) + 1
              ELSE w.used + len(h.lines[w.i + 1]) + 1 END
  FROM walk w JOIN heads h USING (document_id) WHERE w.i < len(h.lines)),
parts AS (
  SELECT document_id, part, any_value(h.lines[1]) || chr(10) || any_value(h.lines[2]) || chr(10)
         || string_agg(h.lines[i], chr(10) ORDER BY i) AS content
  FROM walk JOIN heads h USING (document_id) GROUP BY 1, 2
  UNION ALL SELECT document_id, 1, markdown FROM markdown WHERE markdown <> '' AND len(markdown) <= {size})"""


_PARTS = parts_cte(_MAX)


@query("cells_markdown", f"WITH {_MARKDOWN} SELECT document_id, markdown FROM markdown")
def cells_markdown(spark, sf_dir):
    grids = X.text_tables(spark, sf_dir)
    return grids.select("document_id", B.cells_to_markdown(F.col("cells")).alias("markdown"))


@query(
    "pad_table_rows",
    "WITH r AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line FROM documents), "
    "w AS (SELECT document_id, count(*) AS n_rows, max(len(string_split(line, ','))) + 1 AS width FROM r GROUP BY 1) "
    "SELECT document_id, n_rows * width AS n_cells FROM w",
)
def pad_table_rows(spark, sf_dir):
    widest = F.array_max(F.transform("cells", lambda row: F.size(row)))
    return X.text_tables(spark, sf_dir).select(
        "document_id",
        F.size(F.flatten(B.pad_rows(F.col("cells"), widest))).cast("bigint").alias("n_cells"),
    )


def _text_parts(spark, sf_dir):
    markdown = X.text_tables(spark, sf_dir).select(
        "document_id", B.cells_to_markdown(F.col("cells")).alias("markdown")
    )
    return markdown.select(
        "document_id", "markdown", F.posexplode(B.split_table(F.col("markdown"), _MAX)).alias("p", "content")
    )


@query(
    "table_split",
    f"WITH RECURSIVE {_PARTS} SELECT document_id, CAST(part AS INTEGER) AS part, content FROM parts",
)
def table_split(spark, sf_dir):
    return _text_parts(spark, sf_dir).select("document_id", (F.col("p") + 1).alias("part"), "content")


@query(
    "table_split_rebuild",
    f"WITH {_MARKDOWN}, l AS (SELECT document_id, unnest(string_split(markdown, chr(10))) AS line, "
    "generate_subscripts(string_split(markdown, chr(10)), 1) AS i FROM markdown WHERE markdown <> '') "
    "SELECT document_id, line, count(*) AS n FROM l WHERE i > 2 GROUP BY ALL",
)
def table_split_rebuild(spark, sf_dir):
    """Rows of all parts without their repeated header: exactly the rows of the table."""
    rows = F.slice(T.split_lines(F.col("content")), 3, 1_000_000_000)
    return (
        _text_parts(spark, sf_dir)
        .select("document_id", F.explode(rows).alias("line"))
        .groupBy("document_id", "line")
        .agg(F.count("*").alias("n"))
    )


_INSIDE = f"""WITH {X.LAYOUT_CTE},
inside AS (
  SELECT DISTINCT b.document_id, b.page_number, b.ordinal FROM blocks b
  JOIN tables t ON t.document_id = b.document_id AND t.page_number = b.page_number
   AND b.x0 < t.x1 AND b.x1 > t.x0 AND b.y0 < t.y1 AND b.y1 > t.y0)"""


@query(
    "prose_outside_tables",
    f"{_INSIDE} SELECT document_id, page_number, ordinal, text FROM blocks ANTI JOIN inside "
    "USING (document_id, page_number, ordinal)",
)
def prose_outside_tables(spark, sf_dir):
    outside = L.prose_blocks(X.blocks(spark, sf_dir), X.tables(spark, sf_dir))
    return outside.select("document_id", "page_number", "ordinal", "text")


@query(
    "prose_text",
    f"{_INSIDE}, outside AS (SELECT * FROM blocks ANTI JOIN inside USING (document_id, page_number, ordinal)) "
    "SELECT p.document_id, p.page_number, coalesce(string_agg(o.text, chr(10) ORDER BY o.y0, o.ordinal), '') AS prose "
    "FROM (SELECT DISTINCT document_id, page_number FROM blocks) p "
    "LEFT JOIN outside o USING (document_id, page_number) GROUP BY 1, 2",
)
def prose_text(spark, sf_dir):
    return L.prose_text(X.blocks(spark, sf_dir), X.tables(spark, sf_dir))


@query(
    "table_character_share",
    f"{_INSIDE} SELECT b.document_id, CAST(sum(len(b.text)) AS BIGINT) AS n_chars, "
    "CAST(coalesce(sum(len(b.text)) FILTER (WHERE i.ordinal IS NOT NULL), 0) AS BIGINT) AS table_chars, "
    "round(coalesce(sum(len(b.text)) FILTER (WHERE i.ordinal IS NOT NULL), 0) / sum(len(b.text)), 6) AS table_share "
    "FROM blocks b LEFT JOIN inside i USING (document_id, page_number, ordinal) GROUP BY 1",
)
def table_character_share(spark, sf_dir):
    return L.table_character_share(X.blocks(spark, sf_dir), X.tables(spark, sf_dir))


_HEADINGS = f"""
headings AS (
  SELECT document_id, page_number, ordinal, y1, trim(string_split(text, chr(10))[1]) AS section FROM blocks
  WHERE regexp_matches(trim(string_split(text, chr(10))[1]), '^[A-Z\\s]+\\([A-Za-z][A-Za-z\\s,''\\-\\.]*\\)'))"""

_ASOF = f"""{_HEADINGS},
sections AS (
  SELECT t.document_id, t.page_number, t.ordinal, h.section FROM tables t
  LEFT JOIN headings h ON h.document_id = t.document_id AND h.page_number = t.page_number AND h.y1 <= t.y0
  QUALIFY row_number() OVER (PARTITION BY t.document_id, t.page_number, t.ordinal
                             ORDER BY h.y1 DESC NULLS LAST, h.ordinal) = 1)"""


@query(
    "heading_blocks",
    f"WITH {X.LAYOUT_CTE}, {_HEADINGS} SELECT document_id, page_number, ordinal, section FROM headings",
)
def heading_blocks(spark, sf_dir):
    found = L.headings(X.blocks(spark, sf_dir), X.LATIN_HEADING)
    return found.select("document_id", "page_number", "ordinal", "section")


@query(
    "section_asof",
    f"WITH {X.LAYOUT_CTE}, {_ASOF} SELECT document_id, page_number, ordinal, section FROM sections",
)
def section_asof(spark, sf_dir):
    labelled = L.section_for_tables(X.tables(spark, sf_dir), X.blocks(spark, sf_dir), X.LATIN_HEADING)
    return labelled.select("document_id", "page_number", "ordinal", "section")


# pieces are stretches of the text: lines, then words of long lines, then letters of long words;
# a run of short pieces is cut by its running lengths, each cut starting inside the former one
_SIZE, _OVERLAP = 600, 60
_PROSE_CTE = f"""
p1 AS (
  SELECT doc_id, n, len(line) + CASE WHEN n > 1 THEN 1 ELSE 0 END AS size FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
l1 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p1),
p2 AS (
  SELECT doc_id, n, base, m, len(word) + CASE WHEN m > 1 THEN 1 ELSE 0 END AS size FROM (
    SELECT doc_id, n, off AS base, unnest(string_split(piece, ' ')) AS word, generate_subscripts(string_split(piece, ' '), 1) AS m
    FROM (SELECT l1.*, substr(text, CAST(off + 1 AS BIGINT), size) AS piece FROM l1 JOIN documents USING (doc_id) WHERE size >= {_SIZE}))),
l2 AS (SELECT *, base + coalesce(sum(size) OVER (PARTITION BY doc_id, n ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p2),
l3 AS (SELECT doc_id, n, m, off + unnest(range(size)) AS off FROM l2 WHERE size >= {_SIZE}),
pieces AS (
  SELECT doc_id, 0 AS n, 0 AS m, sum(CASE WHEN size >= {_SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY off) AS run, off, size FROM l1 WHERE size > 0
  UNION ALL
  SELECT doc_id, n, 0, sum(CASE WHEN size >= {_SIZE} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n ORDER BY off), off, size FROM l2 WHERE size > 0
  UNION ALL
  SELECT doc_id, n, m, 0, off, 1 FROM l3),
runs AS (
  SELECT doc_id, min(off) AS a, list_append(list(CAST(off AS BIGINT) ORDER BY off), CAST(max(off + size) AS BIGINT)) AS p
  FROM pieces WHERE size < {_SIZE} GROUP BY doc_id, n, m, run),
cuts AS (
  SELECT doc_id, p, CAST(1 AS BIGINT) AS i, len(list_filter(p, lambda x: x <= p[1] + {_SIZE})) AS e FROM runs
  UNION ALL
  SELECT doc_id, p, j, len(list_filter(p, lambda x: x <= p[j] + {_SIZE})) FROM (
    SELECT doc_id, p, len(list_filter(p, lambda x: x < p[e] - least({_OVERLAP}, {_SIZE} - (p[e + 1] - p[e])))) + 1 AS j
    FROM cuts WHERE e < len(p))),
chunks AS (
  SELECT doc_id, p[i] AS start, {X.sql_strip('substr(text, p[i] + 1, p[e] - p[i])')} AS content FROM cuts JOIN documents USING (doc_id))"""
_PROSE = f"""WITH RECURSIVE {_PROSE_CTE}
SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS part, content
FROM chunks WHERE content <> ''"""


def prose_cte(source: str) -> str:
    """``chunks (doc_id, start, content)`` of the texts of a relation (doc_id, text), cut at 600 characters with an overlap of 60."""
    return _PROSE_CTE.replace("documents", source)


@query("prose_chunks", _PROSE)
def prose_chunks(spark, sf_dir):
    """Whole document texts cut at 600 characters with an overlap of 60."""
    parts = C.split_prose(F.col("text"), _SIZE, _OVERLAP)
    return X.documents(spark, sf_dir).select("document_id", F.posexplode(parts).alias("part", "content"))


@query(
    "chunk_dedup",
    f"WITH {X.CHUNKS_CTE} SELECT chunk_id, document_id, page_number, section, content, content_sha256 FROM chunks",
)
def chunk_dedup(spark, sf_dir):
    return X.line_chunks(spark, sf_dir)


def layout_chunks(spark, sf_dir):
    blocks = X.blocks(spark, sf_dir)
    tables = X.tables(spark, sf_dir).withColumn("markdown", B.cells_to_markdown(F.col("cells")))
    pages = blocks.select(
        "document_id", "page_number", F.col("text").alias("raw_text")
    )
    running = P.running_lines(pages, min_page_ratio=0.9)
    return C.chunk_documents(blocks, tables, running, heading=X.LATIN_HEADING)


@query(
    "chunk_documents",
    f"{_INSIDE}, {_ASOF}, outside AS (SELECT * FROM blocks ANTI JOIN inside USING (document_id, page_number, ordinal)), "
    "n AS (SELECT document_id, count(*) AS n_pages FROM blocks GROUP BY 1), "
    "edges AS (SELECT DISTINCT document_id, page_number, ordinal, unnest(string_split(text, chr(10))) AS line FROM blocks), "
    f"keys AS (SELECT DISTINCT document_id, ordinal, {X.sql_key('line')} AS running_key FROM edges), "
    "running AS (SELECT document_id, running_key FROM keys GROUP BY 1, 2 "
    "HAVING count(*) >= (SELECT n_pages FROM n WHERE n.document_id = keys.document_id) * 0.9), "
    "lines AS (SELECT document_id, page_number, y0, ordinal, unnest(string_split(text, chr(10))) AS line, "
    "generate_subscripts(string_split(text, chr(10)), 1) AS i FROM outside), "
    "ranked AS (SELECT *, row_number() OVER w AS a, count(*) OVER (PARTITION BY document_id, page_number) AS c FROM lines "
    "WINDOW w AS (PARTITION BY document_id, page_number ORDER BY y0, ordinal, i)), "
    f"kept AS (SELECT r.* FROM ranked r LEFT JOIN running k ON k.document_id = r.document_id AND k.running_key = {X.sql_key('r.line')} "
    "WHERE k.running_key IS NULL OR (r.a > 3 AND r.a <= r.c - 3)), "
    "prose AS (SELECT document_id, page_number, 'prose' AS kind, CAST(NULL AS VARCHAR) AS section, "
    "string_agg(line, chr(10) ORDER BY a) AS content, 0 AS kind_rank, 0.0 AS y, 0 AS tie FROM kept GROUP BY 1, 2), "
    "tab AS (SELECT t.document_id, t.page_number, 'table' AS kind, s.section, t.markdown AS content, 1 AS kind_rank, t.y0 AS y, t.ordinal AS tie "
    "FROM tables t JOIN sections s USING (document_id, page_number, ordinal) "
    "SEMI JOIN blocks b ON b.document_id = t.document_id AND b.page_number = t.page_number), "
    "u AS (SELECT * FROM prose UNION ALL SELECT * FROM tab) "
    "SELECT document_id, page_number, kind, section, content, sha256(content) AS content_sha256, "
    "sha256(document_id || '/' || sha256(content)) AS chunk_id FROM u "
    "QUALIFY row_number() OVER (PARTITION BY document_id, content ORDER BY page_number, kind_rank, y, tie) = 1",
)
def chunk_documents(spark, sf_dir):
    return layout_chunks(spark, sf_dir).select(
        "document_id", "page_number", "kind", "section", "content", "content_sha256", "chunk_id"
    )
