"""The whole ingest in one batch and as a stream into a store, and what the store holds afterwards."""

from functools import cache

from pyspark.sql import SparkSession, functions as F

from quirework.functions import text as T, vectors as V
from quirework.functions.common import scratch_path
from quirework.operators import ingestion as I, tables as B
from quirework.plans import fixtures as X, layout_plans as Y, page_plans as P
from quirework.plans.catalog import query
from quirework.sources import schemas, sinks, versions
from quirework.streaming import ingest_stream as S

_AT = "2026-01-01 00:00:00"
_OPTIONS = dict(
    chunk_options=dict(max_chars=600, overlap=60),
    gate_options=dict(combining_ratio_min=0.02, combining=X.VOWEL_MARKS, consonant=X.CONSONANTS),
)
_ARRIVED = "doc_id long, text string, lang string, source string, n_chars long, declared int"


def inputs_of(arrived):
    """(files, pages, blocks, tables) of document rows with the number of pages that their sender declares.

    A page is one block; every fifth document has a table of its lines under the block of its first page.
    """
    named = arrived.withColumnRenamed("doc_id", "document_id")
    text_id = F.col("document_id").cast("string").alias("document_id")
    volumes = X.registry_of(arrived).join(named.select("document_id", "declared"), "document_id")
    files = volumes.select(text_id, "source", "title_th", "edition_year_be", "scopes", "file_hash", F.col("declared").alias("page_count"))
    pages = X.pages_of(named).select(text_id, "ordinal", "page_number", "raw_text")
    box = lambda y: F.struct(F.lit(0.0).alias("x0"), F.lit(y).alias("y0"), F.lit(100.0).alias("x1"), F.lit(y + 90).alias("y1"))
    blocks = pages.select("document_id", F.lit(0).alias("ordinal"), "page_number", box(0.0).alias("bbox"), F.col("raw_text").alias("text"))
    cells = F.transform(T.split_lines(F.col("text")), lambda line: F.concat(F.array(F.lit("")), F.split(line, ",", -1)))
    tables = named.filter("document_id % 5 = 2").select(
        text_id, F.lit(1).alias("ordinal"), F.lit(1).alias("page_number"), box(200.0).alias("bbox"), B.cells_to_markdown(cells).alias("markdown")
    )
    return files, pages, blocks, tables


def submissions(spark, sf_dir):
    """Documents as they are sent: in three parts by id. Every ninth declares a page too many; those of the first two parts are sent again, corrected, with the third."""
    docs = X.load(spark, sf_dir, "documents")
    highest = docs.agg(F.max("doc_id").alias("n")).first()["n"]
    key, n_pages = F.col("doc_id"), F.ceil(F.size(T.split_lines(F.col("text"))) / X.LINES_PER_PAGE).cast("int")
    first = docs.select(
        "doc_id", "text", "lang", "source", "n_chars",
        (n_pages + F.when(key % 9 == 0, 1).otherwise(0)).alias("declared"), F.floor(key * 3 / F.lit(highest + 1)).cast("int").alias("round"), F.lit(True).alias("first"),
    )
    again = first.filter("doc_id % 9 = 0 AND round < 2").withColumn("declared", F.col("declared") - 1).withColumn("round", F.lit(2)).withColumn("first", F.lit(False))
    return first.unionByName(again)


_ROUND = "CAST(floor(document_id * 3 / (SELECT max(doc_id) + 1 FROM documents)) AS INTEGER)"
_SENT_ONCE = "SELECT document_id, file_hash, 0 AS round, document_id % 9 <> 0 AS declared_right FROM registry"
_SENT_IN_ROUNDS = f"""SELECT document_id, file_hash, {_ROUND} AS round, document_id % 9 <> 0 AS declared_right FROM registry
  UNION ALL SELECT document_id, file_hash, 2, true FROM registry WHERE document_id % 9 = 0 AND {_ROUND} < 2"""

# a hash is tried with its smallest id of a round; a try counts if its declared pages and its texts are right
_TRIES = f"""
tries AS (
  SELECT round, file_hash, min(CAST(document_id AS VARCHAR)) AS try_id, arg_min(document_id, CAST(document_id AS VARCHAR)) AS doc_id,
         arg_min(declared_right, CAST(document_id AS VARCHAR)) AS declared_right
  FROM ({{sent}}) GROUP BY 1, 2),
measured AS (
  SELECT document_id, sum(len(regexp_extract_all(raw_text, '{X.VOWEL_MARKS}'))) AS marks,
         sum(len(regexp_extract_all(raw_text, '{X.CONSONANTS}'))) AS consonants
  FROM doc_pages GROUP BY 1),
judged AS (
  SELECT t.*, declared_right AND consonants > 0 AND marks / consonants >= 0.02 AS good
  FROM tries t JOIN measured m ON m.document_id = t.doc_id),
owned AS (
  SELECT file_hash, arg_min(try_id, round) AS document_id, arg_min(doc_id, round) AS owner, arg_min(doc_id, round) FILTER (WHERE good) AS content_of
  FROM judged GROUP BY 1),
taken AS (
  SELECT o.document_id, o.content_of, r.edition_year_be, r.scopes, CASE WHEN o.content_of IS NULL THEN 'pending' ELSE 'active' END AS status
  FROM owned o JOIN registry r ON r.document_id = o.owner),
per_scope AS (SELECT document_id, unnest(scopes) AS scope, edition_year_be FROM taken WHERE status = 'active'),
newest AS (SELECT scope, max(edition_year_be) AS newest_year FROM per_scope GROUP BY 1),
covered AS (SELECT document_id FROM per_scope JOIN newest USING (scope) GROUP BY 1 HAVING bool_and(newest_year > edition_year_be)),
final AS (
  SELECT t.*, CASE WHEN c.document_id IS NOT NULL THEN 'archived' ELSE status END AS state
  FROM taken t LEFT JOIN covered c ON c.document_id = t.document_id)"""

_PASSAGES = f"""
page_texts AS (
  SELECT CAST(document_id AS VARCHAR) || '/' || page_number AS doc_id, {X.sql_collapse('text')} AS text FROM f_text),
{Y.prose_cte('page_texts')},
{Y.parts_cte(600)},
passages AS (
  SELECT CAST(string_split(doc_id, '/')[1] AS BIGINT) AS doc_id, CAST(string_split(doc_id, '/')[2] AS INTEGER) AS page_number, 'prose' AS kind,
         0 AS kind_rank, start AS place, content FROM chunks WHERE content <> ''
  UNION ALL
  SELECT document_id, 1, 'table', 1, part, content FROM parts WHERE document_id % 5 = 2),
held AS (
  SELECT f.document_id, f.state, p.page_number, p.kind, p.content, sha256(p.content) AS content_sha256
  FROM final f JOIN passages p ON p.doc_id = f.content_of
  QUALIFY row_number() OVER (PARTITION BY f.document_id, p.content ORDER BY p.page_number, p.kind_rank, p.place) = 1),
counts AS (SELECT document_id, count(*) AS n FROM held GROUP BY 1),
corpus AS (
  SELECT f.document_id, f.state AS status, CASE WHEN f.content_of IS NOT NULL THEN CAST(coalesce(n, 0) AS VARCHAR) END AS chunk_count,
         CAST(h.page_number AS VARCHAR) AS page_number, h.kind, h.content_sha256
  FROM final f LEFT JOIN counts c ON c.document_id = f.document_id
  LEFT JOIN (SELECT * FROM held WHERE state = 'active') h ON h.document_id = f.document_id)"""


def _sql(sent: str, select: str) -> str:
    before = f"WITH RECURSIVE {P.STRIPPED_CTE} {P.furniture_cte('stripped', 'text')}, {X.REGISTRY_CTE}"
    return f"{before}, {_TRIES.format(sent=sent)}, {_PASSAGES} {select}"


def corpus_rows(documents, chunks):
    """Every registered document with its state, and its passages if it has any."""
    own = chunks.select("document_id", F.col("page_number").cast("string").alias("page_number"), "kind", "content_sha256")
    stated = documents.select("document_id", "status", F.col("chunk_count").cast("string").alias("chunk_count"))
    return stated.join(own, "document_id", "left")


@query("ingest_documents", _sql(_SENT_ONCE, "SELECT * FROM corpus"))
def ingest_documents(spark, sf_dir):
    """All documents in one batch into an empty corpus: gate, passages, vectors, promotion."""
    first = submissions(spark, sf_dir).filter("first")
    nothing = [spark.createDataFrame([], s) for s in (schemas.DOCUMENTS, schemas.CHUNKS)]
    documents, chunks, _ = I.ingest(
        *inputs_of(first), *_sorted_columns(nothing), V.hashing_embedder(X.DIMENSION), X.DIMENSION, X.MODEL, F.lit(_AT), **_OPTIONS
    )
    return corpus_rows(documents, chunks)


def run_stream(spark, sf_dir) -> str:
    """The store that the stream leaves behind: rounds arrive one after another."""
    root = scratch_path(spark, "streamed-corpus")
    sent = submissions(spark, sf_dir)
    for number in range(3):
        sent.filter(F.col("round") == number).drop("round", "first").write.mode("append").parquet(f"{root}/arrivals")
        arriving = spark.readStream.schema(_ARRIVED).parquet(f"{root}/arrivals")
        S.ingest_stream(
            arriving, root, inputs_of, V.hashing_embedder(X.DIMENSION), X.DIMENSION, X.MODEL, F.lit(_AT), **_OPTIONS
        ).awaitTermination()
    return root


@cache
def _kept_stream(application: str, sf_dir: str) -> str:
    return run_stream(SparkSession.active(), sf_dir)


@query("ingest_stream", _sql(_SENT_IN_ROUNDS, "SELECT * FROM corpus"))
def run_ingest_stream(spark, sf_dir):
    """Documents arriving in three rounds: duplicates refused, failed ones tried again, editions superseded; the store afterwards."""
    corpus = S.read_corpus(spark, run_stream(spark, sf_dir))
    return corpus_rows(corpus["documents"], corpus["chunks"])


@query(
    "stored_postings",
    _sql(_SENT_IN_ROUNDS, "").rstrip()
    + f""", words AS (
  SELECT document_id, content_sha256, unnest({X.sql_tokens('content')}) AS term FROM held WHERE state = 'active')
SELECT term, count(DISTINCT document_id || '/' || content_sha256) AS n_chunks, count(*) AS n_places FROM words GROUP BY 1""",
)
def stored_postings(spark, sf_dir):
    """Terms of the streamed store's inverted index, which batches, retries and supersession keep up to date."""
    corpus = S.read_corpus(spark, _kept_stream(spark.sparkContext.applicationId, sf_dir))
    return corpus["postings"].groupBy("term").agg(
        F.count("*").alias("n_chunks"), F.sum(F.size("positions")).alias("n_places")
    )


def _sorted_columns(frames):
    documents, chunks = frames
    return documents, chunks.select("chunk_id", "document_id", "page_number", "kind_rank", "position", "part", "section", "kind", "content", "content_sha256", "tokens", "embedding")


_STORED = "chunk_id string, document_id long, page_number int, section string, content string, content_sha256 string"


@query(
    "write_chunks",
    f"WITH {X.CHUNKS_CTE} SELECT document_id, page_number, section, "
    "CASE WHEN document_id % 10 = 3 THEN 'new ' || content ELSE content END AS content FROM chunks WHERE document_id % 10 <> 5",
)
def write_chunks(spark, sf_dir):
    """The stored passages after a first write, a batch that replaces some documents and drops others, and a merge of the deltas."""
    root = scratch_path(spark, "chunk-store")
    chunks = X.line_chunks(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    nothing = chunks.select("document_id").limit(0)
    sinks.write_chunks(chunks, nothing, root)
    changed = chunks.filter("document_id % 10 = 3").withColumn("content", F.concat(F.lit("new "), "content"))
    dropped = chunks.filter("document_id % 10 = 5").select("document_id")
    sinks.write_chunks(changed, dropped, root)
    versions.compact(spark, root, sinks.TABLE, _STORED, most=1)
    return sinks.read_chunks(spark, root, _STORED).select("document_id", "page_number", "section", "content")
