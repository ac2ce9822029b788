"""Corpus inputs derived from the given tables, each with the same derivation in SQL."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirework.functions import text as T
from quirework.operators.chunks import keep_first_copies
from quirework.operators.pages import paginate
from quirework.sources.readers import spread_small_input

LINES_PER_PAGE = 3
LANGS = ["en", "fr", "de", "es"]
SCOPES = [f"src{i}-{lang}" for i in range(20) for lang in LANGS]
MODEL = "hashing-64"
DIMENSION = 64

# Latin forms of the script-dependent parameters.
VOWEL_MARKS = "[éèêóñçüäöíÉÈÊÓÑÇÜÄÖÍ]"
CONSONANTS = "[b-df-hj-np-tv-z]"
LATIN_HEADING = r"^[A-Z\s]+\([A-Za-z][A-Za-z\s,'\-\.]*\)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small_input(df) if name == "documents" else df


def sql_strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def sql_collapse(x: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace({sql_strip(x)}, '[ \\t]+', ' ', 'g'), "
        "'\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t\\r]+\\n', chr(10), 'g')"
    )


def sql_key(x: str) -> str:
    return sql_collapse(f"regexp_replace({x}, '[0-9]+', '#', 'g')")


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


def messy_text() -> "F.Column":
    """Whole texts with tabs, runs of blanks and blank lines put in."""
    spaced = F.replace("text", F.lit(", "), F.lit(" \t  "))
    return F.concat(
        F.lit(" \n"), F.replace(spaced, F.lit(".\n"), F.lit(". \t\n\n \n\n\n  ")), F.lit("  \n")
    )


MESSY_SQL = (
    "' ' || chr(10) || replace(replace(text, ', ', ' ' || chr(9) || '  '), '.' || chr(10), "
    "'. ' || chr(9) || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || '  ') || '  ' || chr(10)"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three lines under a running header, with a page number at the foot and a
    dot leader after the header's title."""
    return pages_of(documents(spark, sf_dir))


def pages_of(docs: DataFrame) -> DataFrame:
    cut = paginate(docs, LINES_PER_PAGE, ["source"])
    number = F.col("page_number").cast("string")
    return cut.select(
        "document_id",
        "ordinal",
        "page_number",
        F.concat(
            F.lit("Handbook "), "source", F.lit("   "), number, F.lit("\n"),
            "raw_text", F.lit(" ..... "), number, F.lit("\n- "), number, F.lit(" -"),
        ).alias("raw_text"),
    )


PAGES_CTE = """
doc_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents),
doc_pages AS (
  SELECT doc_id AS document_id, CAST((n - 1) // 3 + 1 AS INTEGER) AS page_number,
         'Handbook ' || source || '   ' || ((n - 1) // 3 + 1) || chr(10)
           || string_agg(line, chr(10) ORDER BY n) || ' ..... ' || ((n - 1) // 3 + 1)
           || chr(10) || '- ' || ((n - 1) // 3 + 1) || ' -' AS raw_text
  FROM doc_lines GROUP BY doc_id, source, (n - 1) // 3),
page_lines AS (
  SELECT document_id, page_number, unnest(string_split(raw_text, chr(10))) AS line,
         generate_subscripts(string_split(raw_text, chr(10)), 1) AS n
  FROM doc_pages),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY n) AS a,
         row_number() OVER (PARTITION BY document_id, page_number ORDER BY n DESC) AS d
  FROM page_lines WHERE """ + sql_strip("line") + """ <> '')"""

RUNNING_CTE = PAGES_CTE + """,
page_totals AS (SELECT document_id, count(*) AS n_pages FROM doc_pages GROUP BY 1),
running AS (
  SELECT document_id, running_key, pages_seen, n_pages FROM (
    SELECT document_id, running_key, count(*) AS pages_seen FROM (
      SELECT DISTINCT document_id, page_number, """ + sql_key("line") + """ AS running_key
      FROM filled WHERE a <= 3 OR d <= 3) GROUP BY 1, 2)
  JOIN page_totals USING (document_id) WHERE pages_seen >= n_pages * 0.5)"""


def with_codes(text: "F.Column") -> "F.Column":
    """Accented letters as private-use codes, some of them unmapped."""
    return F.translate(text, "éèóñäí", "\uf70a\uf710\uf707\uf718\uf061\uf71a")


def pua_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose accented letters are stored as private-use codes."""
    return pages(spark, sf_dir).withColumn("raw_text", with_codes(F.col("raw_text")))


PUA_SQL = "translate({x}, 'éèóñäí', chr(63242) || chr(63248) || chr(63239) || chr(63256) || chr(61537) || chr(63258))"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as registered volumes with an edition year, scopes and a status."""
    return registry_of(load(spark, sf_dir, "documents"))


def registry_of(d: DataFrame) -> DataFrame:
    lang, key = F.col("lang"), F.col("doc_id")
    other = F.concat(F.lit("src"), ((key * 3) % 20).cast("string"), F.lit("-"), lang)
    return d.select(
        key.alias("document_id"),
        "source",
        F.concat(F.lit("Volume "), key.cast("string")).alias("title_th"),
        (2560 + (key * 7 + F.col("n_chars")) % 10).cast("int").alias("edition_year_be"),
        F.array_distinct(F.array(F.concat("source", F.lit("-"), lang), other)).alias("scopes"),
        F.when(key % 10 < 2, "pending").when(key % 10 < 4, "archived").otherwise("active").alias("status"),
        F.sha2("text", 256).alias("file_hash"),
        F.ceil(F.size(T.split_lines(F.col("text"))) / LINES_PER_PAGE).cast("int").alias("page_count"),
        F.lit(None).cast("bigint").alias("chunk_count"),
        F.when(key % 50 == 7, F.lit(None)).when(key % 50 == 9, "older-model").otherwise(MODEL).alias("embedding_model"),
        F.lit(None).cast("timestamp").alias("archived_at"),
        "text",
        "n_chars",
    )


REGISTRY_CTE = """
registry AS (
  SELECT doc_id AS document_id, source, 'Volume ' || doc_id AS title_th,
         CAST(2560 + (doc_id * 7 + n_chars) % 10 AS INTEGER) AS edition_year_be,
         CASE WHEN source = 'src' || ((doc_id * 3) % 20) THEN [source || '-' || lang]
              ELSE [source || '-' || lang, 'src' || ((doc_id * 3) % 20) || '-' || lang] END AS scopes,
         CASE WHEN doc_id % 10 < 2 THEN 'pending' WHEN doc_id % 10 < 4 THEN 'archived' ELSE 'active' END AS status,
         sha256(text) AS file_hash,
         CAST(ceil(len(string_split(text, chr(10))) / 3.0) AS INTEGER) AS page_count,
         CASE WHEN doc_id % 50 = 7 THEN NULL WHEN doc_id % 50 = 9 THEN 'older-model' ELSE 'hashing-64' END AS embedding_model,
         text, n_chars
  FROM documents)"""


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One passage per distinct non-blank line of a document, first copy kept."""
    return line_chunks_of(documents(spark, sf_dir))


def line_chunks_of(docs: DataFrame) -> DataFrame:
    lines = docs.select(
        "document_id", F.posexplode(T.split_lines(F.col("text"))).alias("n", "line")
    )
    lines = lines.filter(~T.is_blank(F.col("line")))
    return keep_first_copies(
        lines.select(
            F.concat_ws("/", F.col("document_id").cast("string"), F.col("n").cast("string")).alias("chunk_id"),
            "document_id",
            "n",
            (F.floor(F.col("n") / LINES_PER_PAGE) + 1).cast("int").alias("page_number"),
            F.when(F.col("n") % 2 == 1, "odd line").alias("section"),
            T.collapse_whitespace(F.col("line")).alias("content"),
        ).withColumn("content_sha256", T.sha256(F.col("content"))),
        ["n"],
    ).drop("n")


CHUNKS_CTE = """
chunk_lines AS (
  SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
chunks AS (
  SELECT document_id || '/' || n AS chunk_id, document_id, CAST(n // 3 + 1 AS INTEGER) AS page_number,
         CASE WHEN n % 2 = 1 THEN 'odd line' END AS section, content, sha256(content) AS content_sha256
  FROM (SELECT document_id, n, """ + sql_collapse("line") + """ AS content FROM chunk_lines)
  WHERE content <> ''
  QUALIFY row_number() OVER (PARTITION BY document_id, content ORDER BY n) = 1)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every benchmark item as a question."""
    return (
        load(spark, sf_dir, "benchmark")
        .select("item_id", F.posexplode(F.split("text", r"\.\s+", -1)).alias("n", "question"))
        .select(F.concat_ws("/", F.col("item_id").cast("string"), F.col("n").cast("string")).alias("question_id"), "question")
    )


QUESTIONS_CTE = """
questions AS (
  SELECT item_id || '/' || (generate_subscripts(string_split_regex(text, '\\.\\s+'), 1) - 1) AS question_id,
         unnest(string_split_regex(text, '\\.\\s+')) AS question
  FROM benchmark)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as positioned text blocks on their customer's pages."""
    k = F.col("o_orderkey")
    x0, y0 = (k * 13 % 200).cast("double"), (k * 37 % 700).cast("double")
    heading = F.concat(
        F.lit("SECTION ("), F.substring("o_orderpriority", 3, 20), F.lit(")\n"), "o_orderpriority"
    )
    plain = F.concat(F.lit("order "), k.cast("string"), F.lit(" status "), "o_orderstatus")
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"),
        (k % 3 + 1).cast("int").alias("page_number"),
        k.alias("ordinal"),
        F.struct(
            x0.alias("x0"), y0.alias("y0"), (x0 + 150).alias("x1"), (y0 + 20 + k % 5 * 6).alias("y1")
        ).alias("bbox"),
        F.when(F.col("o_orderstatus") == "F", heading).otherwise(plain).alias("text"),
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as located tables on their part's pages, made distinct where the pages lie: rows of a page
    stay together afterwards, and what crosses the shuffle is keys."""
    o, n, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    x0, y0 = (o * 7 % 300).cast("double"), ((o * 11 + n * 53) % 700).cast("double")
    return (
        load(spark, sf_dir, "lineitem")
        .select(
            F.col("l_partkey").alias("document_id"),
            (s % 3 + 1).cast("int").alias("page_number"),
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
        )
        .repartition("document_id", "page_number")
        .distinct()
        .select(
            "document_id",
            "page_number",
            ((o * 10 + n) * 100000 + s).alias("ordinal"),
            F.struct(
                x0.alias("x0"), y0.alias("y0"), (x0 + 100).alias("x1"), (y0 + 60).alias("y1")
            ).alias("bbox"),
            F.array(
                F.array(F.lit("order"), F.lit(""), F.lit("line"), F.lit("supplier")),
                F.array(o.cast("string"), F.lit(""), n.cast("string"), s.cast("string")),
            ).alias("cells"),
        )
    )


LAYOUT_CTE = """
blocks AS (
  SELECT o_custkey AS document_id, CAST(o_orderkey % 3 + 1 AS INTEGER) AS page_number, o_orderkey AS ordinal,
         CAST(o_orderkey * 13 % 200 AS DOUBLE) AS x0, CAST(o_orderkey * 37 % 700 AS DOUBLE) AS y0,
         CAST(o_orderkey * 13 % 200 + 150 AS DOUBLE) AS x1,
         CAST(o_orderkey * 37 % 700 + 20 + o_orderkey % 5 * 6 AS DOUBLE) AS y1,
         CASE WHEN o_orderstatus = 'F'
              THEN 'SECTION (' || substr(o_orderpriority, 3) || ')' || chr(10) || o_orderpriority
              ELSE 'order ' || o_orderkey || ' status ' || o_orderstatus END AS text
  FROM orders),
tables AS (
  SELECT l_partkey AS document_id, CAST(l_suppkey % 3 + 1 AS INTEGER) AS page_number,
         (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS ordinal,
         CAST(l_orderkey * 7 % 300 AS DOUBLE) AS x0,
         CAST((l_orderkey * 11 + l_linenumber * 53) % 700 AS DOUBLE) AS y0,
         CAST(l_orderkey * 7 % 300 + 100 AS DOUBLE) AS x1,
         CAST((l_orderkey * 11 + l_linenumber * 53) % 700 + 60 AS DOUBLE) AS y1,
         '|order|line|supplier|' || chr(10) || '|---|---|---|' || chr(10) || '|' || l_orderkey || '|'
           || l_linenumber || '|' || l_suppkey || '|' AS markdown
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))"""


def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a cell grid: a row per line, a cell per comma, an empty first column."""
    cells = F.transform(
        T.split_lines(F.col("text")), lambda line: F.concat(F.array(F.lit("")), F.split(line, ",", -1))
    )
    return documents(spark, sf_dir).select("document_id", cells.alias("cells"))


