"""Line deduplication over overlapping three-line windows (DataFrame functions only).

A window is three consecutive lines. Of equal windows the first by (document id, line) is kept; every
line that a later one covers is removed, and covered lines that touch or overlap become one span.
Windows are judged on the input, not on what is left.

Equal windows are found by their MD5. Occurrences are reduced per (window, salt) inside the map tasks
and per salt before they meet, so a window on a third of all rows reaches its last task as a few rows;
the join that finds its later occurrences is one that adaptive execution can split.

Cases: a null text counts as empty (one empty line); fewer than three lines have no window; an empty
table gives an empty result; rows that repeat an id are told apart by text, and rows equal in both are
copies of one document whose windows are not later than each other; other columns are not read.
"""

from pyspark.sql import DataFrame, functions as F, Window

LINES = 3
SALTS = 32


def line_windows(docs: DataFrame) -> DataFrame:
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (LINES - 1)),
        lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", i, LINES)))),
    )
    return docs.where(F.size("lines") >= LINES).select("doc_id", "text_key", F.posexplode(hashes).alias("pos", "window"))


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Windows with more than one occurrence, each with the place of its first one."""
    place = F.struct("doc_id", "pos")
    return (
        windows.groupBy("window", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .groupBy("window")
        .agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        .where("n > 1")
        .drop("n")
    )


def covered_spans(later: DataFrame) -> DataFrame:
    """Maximal removed line spans per document, from the places of later windows."""
    order = Window.partitionBy("doc_id", "text_key").orderBy("pos")
    return (
        later.withColumn("opens", (F.col("pos") > F.lag("pos", 1, -LINES - 1).over(order) + LINES).cast("int"))
        .withColumn("span", F.sum("opens").over(order))
        .groupBy("doc_id", "text_key", "span")
        .agg((F.min("pos") + 1).alias("start"), (F.max("pos") + LINES).alias("end"))
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_lines, n_removed, n_spans`` per row; ``text`` holds the kept lines."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text", F.length("text")).alias("text_key"), F.split("text", "\n", -1).alias("lines")
    )
    windows = line_windows(lines)
    later = (
        windows.join(repeated_windows(windows), "window")
        .where(F.struct("doc_id", "pos") > F.col("first"))
        .select("doc_id", "text_key", "pos")
        .distinct()
    )
    spans = F.coalesce(F.col("s.spans"), F.array().cast("array<struct<start:int,end:int>>"))
    same = F.expr("l.doc_id <=> s.doc_id AND l.text_key = s.text_key")
    kept = F.flatten(
        F.zip_with(
            F.concat(F.array(F.lit(0)), F.col("spans.end")),
            F.concat(F.col("spans.start"), F.array(F.size("lines") + 1)),
            lambda end, start: F.slice("lines", end + 1, start - end - 1),
        )
    )
    return (
        lines.alias("l")
        .join(covered_spans(later).alias("s"), same, "left")
        .select("l.doc_id", "lines", spans.alias("spans"))
        .select(
            "doc_id",
            F.concat_ws("\n", kept).alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"] + 1).alias("n_removed"),
            F.size("spans").cast("long").alias("n_spans"),
        )
    )


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


QUERY_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line,
         len(string_split(coalesce(text, ''), chr(10))) AS n_lines
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(pos)
), w AS (
  SELECT a.doc_id, a.pos, md5(a.line || chr(10) || b.line || chr(10) || c.line) AS h
  FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN l c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
), later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM later, unnest([0, 1, 2]) AS s(d)
), marked AS (
  SELECT l.*, g.pos IS NOT NULL AS removed,
         g.pos IS NOT NULL AND lag(g.pos) OVER (PARTITION BY l.doc_id ORDER BY l.pos) IS NULL AS opens
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
)
SELECT doc_id, max(n_lines)::BIGINT AS n_lines, count(*) FILTER (removed) AS n_removed, count(*) FILTER (opens) AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
