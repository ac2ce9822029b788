"""Registry, object claims, supersession and integrity."""

from pyspark.sql import functions as F

from quirework.operators import registry as G, supersede as S
from quirework.plans import fixtures as X
from quirework.plans.catalog import query
from quirework.sources.readers import read_file_hashes

_UPLOADS = """
uploads AS (
  SELECT doc_id, source, sha256(text || CASE WHEN doc_id % 4 = 1 THEN ' second edition' ELSE '' END) AS file_hash,
         len(text) AS size FROM documents),
known AS (
  SELECT file_hash, document_id, status FROM registry
  QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY document_id) = 1)"""
_WITH = f"WITH {X.REGISTRY_CTE}, {_UPLOADS}"


def uploads(spark, sf_dir):
    """Incoming files: most documents again, every fourth with new content."""
    docs = X.load(spark, sf_dir, "documents")
    suffix = F.when(F.col("doc_id") % 4 == 1, " second edition").otherwise("")
    return docs.select(
        "doc_id", "source", F.sha2(F.concat("text", suffix), 256).alias("file_hash"), F.length("text").alias("size")
    )


def known(spark, sf_dir):
    return G.first_of_each_hash(X.registry(spark, sf_dir), "document_id")


@query("file_hash")
def file_hash(spark, sf_dir):
    """Byte hash of every parquet file of the data set."""
    hashes = read_file_hashes(spark, sf_dir, "*.parquet")
    return hashes.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "file_hash")


@query(
    "duplicate_hash",
    f"{_WITH} SELECT file_hash, min(doc_id) AS first_doc_id FROM uploads GROUP BY 1",
)
def duplicate_hash(spark, sf_dir):
    first = G.first_of_each_hash(uploads(spark, sf_dir), "doc_id")
    return first.select("file_hash", F.col("doc_id").alias("first_doc_id"))


@query(
    "hash_lookup",
    f"{_WITH} SELECT doc_id, file_hash, CAST(document_id AS VARCHAR) AS document_id, status FROM uploads LEFT JOIN known USING (file_hash)",
)
def hash_lookup(spark, sf_dir):
    files = uploads(spark, sf_dir).select("doc_id", "file_hash")
    found = G.lookup_by_hash(files, known(spark, sf_dir))
    return found.withColumn("document_id", F.col("document_id").cast("string")).select(
        "doc_id", "file_hash", "document_id", "status"
    )


@query(
    "admission_action",
    f"{_WITH} SELECT doc_id, CASE WHEN status IS NULL THEN 'insert' WHEN status = 'pending' THEN 'update' "
    "ELSE 'refuse' END AS action FROM uploads LEFT JOIN known USING (file_hash)",
)
def admission_action(spark, sf_dir):
    files = uploads(spark, sf_dir).select("doc_id", "file_hash")
    return G.admission(files, known(spark, sf_dir)).select("doc_id", "action")


@query(
    "ingest_summary",
    f"{_WITH} SELECT doc_id, CASE WHEN status IS NOT NULL THEN status WHEN file_hash IN "
    "(SELECT file_hash FROM uploads WHERE doc_id % 8 = 1) THEN 'in_progress' ELSE 'not_found' END AS state "
    "FROM uploads LEFT JOIN known USING (file_hash)",
)
def ingest_summary(spark, sf_dir):
    files = uploads(spark, sf_dir).select("doc_id", "file_hash")
    in_flight = files.filter("doc_id % 8 = 1")
    documents = known(spark, sf_dir).withColumn("qa", F.lit(None).cast("string"))
    return G.ingest_summary(files, documents, in_flight).select("doc_id", "state")


@query(
    "pending_rows",
    f"{_WITH} SELECT sha256('document/' || file_hash) AS document_id, any_value(source) AS source, 'pending' AS status, "
    "file_hash, 'none' AS chunk_count, 1 AS n_checks FROM uploads GROUP BY file_hash "
    "HAVING file_hash NOT IN (SELECT file_hash FROM known) OR min(doc_id) < 0",
)
def pending_rows(spark, sf_dir):
    files = G.first_of_each_hash(uploads(spark, sf_dir), "doc_id")
    new = G.admission(files, known(spark, sf_dir).select("file_hash", "document_id", "status")).filter(
        "action = 'insert'"
    )
    rows = new.select(
        G.document_id_for(F.col("file_hash")).alias("document_id"),
        "source",
        F.col("source").alias("title_th"),
        F.lit(2568).alias("edition_year_be"),
        F.array(F.lit("fungicide")).alias("scopes"),
        "file_hash",
        F.lit(1).alias("page_count"),
    )
    qa = rows.select(
        "document_id",
        F.lit("scopes_empty").alias("check"),
        F.lit(True).alias("passed"),
        F.lit("[]").alias("measured"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return G.pending_rows(rows, qa, F.lit("2026-01-01 00:00:00"), "spark").select(
        "document_id", "source", "status", "file_hash",
        F.coalesce(F.col("chunk_count").cast("string"), F.lit("none")).alias("chunk_count"),
        F.size("qa").alias("n_checks"),
    )


@query(
    "overwrite_qa",
    f"{_WITH} SELECT document_id, status, CASE WHEN n_chars % 2 = 0 THEN 'new' ELSE 'old' END || ' ' || n_chars AS measured FROM registry",
)
def overwrite_qa(spark, sf_dir):
    def record(measured):
        return [
            F.lit("thin_pages").alias("check"),
            F.lit(True).alias("passed"),
            F.concat(F.lit(measured + " "), F.col("n_chars").cast("string")).alias("measured"),
            F.lit(1.0).alias("threshold"),
        ]

    base = X.registry(spark, sf_dir)
    result = F.struct(*record("old")[1:])
    documents = base.withColumn("qa", F.create_map(F.lit("thin_pages"), result))
    fresh = base.filter("n_chars % 2 = 0").select("document_id", *record("new"))
    return G.overwrite_qa(documents, fresh).select(
        "document_id", "status", F.col("qa")["thin_pages"]["measured"].alias("measured")
    )


@query(
    "clear_pending_chunks",
    f"WITH {X.REGISTRY_CTE}, {X.CHUNKS_CTE} SELECT chunk_id FROM chunks JOIN registry USING (document_id) "
    "WHERE NOT (status = 'pending' AND n_chars % 2 = 0)",
)
def clear_pending_chunks(spark, sf_dir):
    documents = X.registry(spark, sf_dir)
    again = documents.filter("n_chars % 2 = 0").select("document_id")
    left = G.clear_pending_chunks(X.line_chunks(spark, sf_dir), documents, again)
    return left.select("chunk_id")


@query(
    "chunk_statistics",
    f"WITH {X.REGISTRY_CTE}, {X.CHUNKS_CTE}, n AS (SELECT document_id, count(*) AS n FROM chunks WHERE page_number > 1 GROUP BY 1) "
    "SELECT document_id, CASE WHEN n_chars >= 500 THEN CAST(coalesce(n, 0) AS VARCHAR) END AS chunk_count, "
    "CASE WHEN n_chars >= 500 THEN 'model-b' ELSE embedding_model END AS embedding_model "
    "FROM registry LEFT JOIN n USING (document_id)",
)
def chunk_statistics(spark, sf_dir):
    """Documents of one page have no chunk here, whether they passed or not."""
    chunks = X.line_chunks(spark, sf_dir).filter("page_number > 1")
    documents = X.registry(spark, sf_dir)
    return G.chunk_statistics(documents, documents.filter("n_chars >= 500"), chunks, "model-b").select(
        "document_id", F.col("chunk_count").cast("string").alias("chunk_count"), "embedding_model"
    )


@query(
    "archive_manifest",
    f"WITH {X.REGISTRY_CTE} SELECT file_hash, arg_min(source, document_id) AS source, "
    "'documents/' || file_hash || '.pdf' AS target FROM registry WHERE n_chars >= 500 GROUP BY 1",
)
def archive_manifest(spark, sf_dir):
    documents = X.registry(spark, sf_dir)
    return G.archive_manifest(documents, documents.filter("n_chars >= 500"))


@query(
    "claimable_objects",
    "WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'uploads/' || md5(text) || '.exe' "
    "WHEN 1 THEN '../uploads/' || md5(text) || '.pdf' ELSE 'uploads/' || md5(text || doc_id) || '.pdf' END AS object_name, "
    "len(text) AS size FROM documents), l AS (SELECT * FROM r WHERE doc_id % 7 <> 3) "
    "SELECT r.object_name, CASE WHEN NOT regexp_full_match(r.object_name, 'uploads/[0-9a-f]{32}\\.pdf') THEN 'bad name' "
    "WHEN l.size IS NULL THEN 'missing' WHEN l.size > 4000 THEN 'too large' END AS reason "
    "FROM r LEFT JOIN l ON l.doc_id = r.doc_id",
)
def claimable_objects(spark, sf_dir):
    key = F.col("doc_id")
    name = (
        F.when(key % 5 == 0, F.concat(F.lit("uploads/"), F.md5("text"), F.lit(".exe")))
        .when(key % 5 == 1, F.concat(F.lit("../uploads/"), F.md5("text"), F.lit(".pdf")))
        .otherwise(F.concat(F.lit("uploads/"), F.md5(F.concat("text", key.cast("string"))), F.lit(".pdf")))
    )
    objects = X.load(spark, sf_dir, "documents").select(
        "doc_id", name.alias("object_name"), F.length("text").alias("size")
    )
    listing = objects.filter("doc_id % 7 <> 3").groupBy("object_name").agg(F.max("size").alias("size"))
    return G.claim_objects(objects.select("object_name"), listing, max_bytes=4000).select(
        "object_name", "reason"
    )


@query(
    "model_pin_check",
    f"WITH {X.REGISTRY_CTE} SELECT DISTINCT embedding_model FROM registry WHERE status = 'active' "
    "AND embedding_model IS DISTINCT FROM 'hashing-64'",
)
def model_pin_check(spark, sf_dir):
    return G.models_off_pin(X.registry(spark, sf_dir), X.MODEL)


# the rule as stated: no scope lacks a strictly newer active or archived document
_SETTLED = f"""WITH {X.REGISTRY_CTE},
live AS (
  SELECT * REPLACE (CASE WHEN status = 'pending' AND n_chars >= 1000 THEN 'active' ELSE status END AS status) FROM registry),
scoped AS (SELECT document_id, edition_year_be, status, unnest(scopes) AS scope FROM live),
retired AS (
  SELECT document_id FROM live d WHERE d.status = 'active' AND NOT EXISTS (
    SELECT 1 FROM scoped u WHERE u.document_id = d.document_id AND NOT EXISTS (
      SELECT 1 FROM scoped n WHERE n.status IN ('active', 'archived') AND n.scope = u.scope
        AND n.edition_year_be > u.edition_year_be))),
settled AS (
  SELECT live.* REPLACE (CASE WHEN r.document_id IS NOT NULL THEN 'archived' ELSE status END AS status),
         r.document_id IS NOT NULL AS retired
  FROM live LEFT JOIN retired r ON r.document_id = live.document_id)"""


def settle(spark, sf_dir):
    documents = X.registry(spark, sf_dir)
    passed = documents.filter("n_chars >= 1000")
    return S.promote(documents, X.line_chunks(spark, sf_dir), passed, F.lit("2026-01-01 00:00:00"))


@query(
    "newest_edition_per_scope",
    f"WITH {X.REGISTRY_CTE}, s AS (SELECT unnest(scopes) AS scope, edition_year_be FROM registry WHERE status <> 'pending') "
    "SELECT scope, max(edition_year_be) AS newest_year FROM s GROUP BY 1",
)
def newest_edition_per_scope(spark, sf_dir):
    return S.newest_edition_per_scope(X.registry(spark, sf_dir))


@query("coverage_archived", f"{_SETTLED} SELECT document_id FROM retired")
def coverage_archived(spark, sf_dir):
    documents = X.registry(spark, sf_dir)
    return S.superseded(S.activate(documents, documents.filter("n_chars >= 1000")))


@query(
    "promote_status",
    f"{_SETTLED} SELECT document_id, status, retired AS has_archived_at FROM settled",
)
def promote_status(spark, sf_dir):
    documents, _ = settle(spark, sf_dir)
    return documents.select("document_id", "status", F.col("archived_at").isNotNull().alias("has_archived_at"))


@query(
    "promote_chunks",
    f"{_SETTLED}, {X.CHUNKS_CTE} SELECT chunk_id, content_sha256 FROM chunks "
    "WHERE document_id IN (SELECT document_id FROM settled WHERE status = 'active')",
)
def promote_chunks(spark, sf_dir):
    _, chunks = settle(spark, sf_dir)
    return chunks.select("chunk_id", "content_sha256")


@query(
    "stale_chunks",
    f"WITH {X.REGISTRY_CTE}, {X.CHUNKS_CTE} SELECT document_id, edition_year_be, status, count(*) AS chunk_count "
    "FROM chunks JOIN registry USING (document_id) WHERE status <> 'active' GROUP BY ALL",
)
def stale_chunks(spark, sf_dir):
    return S.stale_chunks(X.line_chunks(spark, sf_dir), X.registry(spark, sf_dir))


@query("stale_chunks_after_promote", f"{_SETTLED} SELECT document_id, edition_year_be, status, CAST(0 AS BIGINT) AS chunk_count FROM settled WHERE false")
def stale_chunks_after_promote(spark, sf_dir):
    documents, chunks = settle(spark, sf_dir)
    return S.stale_chunks(chunks, documents)


@query(
    "citation_join",
    f"WITH {X.REGISTRY_CTE}, {X.CHUNKS_CTE} SELECT chunk_id, c.document_id, page_number, section, edition_year_be, "
    "title_th, source, status FROM chunks c JOIN registry r ON r.document_id = c.document_id",
)
def citation_join(spark, sf_dir):
    return S.chunks_with_documents(X.line_chunks(spark, sf_dir), X.registry(spark, sf_dir)).select(
        "chunk_id", "document_id", "page_number", "section", "edition_year_be", "title_th", "source", "status"
    )


@query(
    "edition_overlap",
    f"WITH {X.REGISTRY_CTE}, l AS (SELECT edition_year_be, unnest(string_split(text, chr(10))) AS line FROM registry), "
    f"d AS (SELECT DISTINCT * FROM l WHERE {X.sql_strip('line')} <> '') "
    "SELECT edition_year_be, count(*) AS n_lines, count(*) FILTER (WHERE repeated) AS n_repeated, "
    "round(count(*) FILTER (WHERE repeated) / count(*), 6) AS repeated_ratio FROM ("
    "SELECT *, EXISTS (SELECT 1 FROM d o WHERE o.line = d.line AND o.edition_year_be < d.edition_year_be) AS repeated FROM d) "
    "GROUP BY 1",
)
def edition_overlap(spark, sf_dir):
    return S.edition_overlap(X.registry(spark, sf_dir).select("edition_year_be", "text"))


@query(
    "corpus_diff",
    f"WITH {X.CHUNKS_CTE}, b AS (SELECT document_id, content_sha256 FROM chunks WHERE section IS NULL), "
    "a AS (SELECT document_id, content_sha256 FROM chunks WHERE page_number <> 2) "
    "(SELECT *, CAST(1 AS BIGINT) AS n_before, CAST(0 AS BIGINT) AS n_after FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) UNION ALL "
    "(SELECT *, 0, 1 FROM (SELECT * FROM a EXCEPT SELECT * FROM b))",
)
def corpus_diff(spark, sf_dir):
    chunks = X.line_chunks(spark, sf_dir)
    return S.corpus_diff(chunks.filter("section is null"), chunks.filter("page_number <> 2"))


_BAD = f"""WITH {X.REGISTRY_CTE},
bad AS (
  SELECT * REPLACE (CASE WHEN document_id % 31 = 2 THEN [] WHEN document_id % 31 = 3 THEN ['other'] ELSE scopes END AS scopes,
                    CASE WHEN document_id % 37 = 4 THEN 'draft' ELSE status END AS status) FROM registry)"""
_DOCUMENT_VIOLATIONS = """
SELECT 'scopes' AS "constraint", CAST(document_id AS VARCHAR) AS subject FROM bad WHERE document_id % 31 IN (2, 3)
UNION ALL SELECT 'status', CAST(document_id AS VARCHAR) FROM bad WHERE status = 'draft'
UNION ALL SELECT 'file_hash', file_hash FROM bad GROUP BY file_hash HAVING count(*) > 1
UNION ALL SELECT 'edition_source', edition_year_be || '/' || source FROM bad GROUP BY edition_year_be, source HAVING count(*) > 1"""


def bad_registry(spark, sf_dir):
    key = F.col("document_id")
    return (
        X.registry(spark, sf_dir)
        .withColumn(
            "scopes",
            F.when(key % 31 == 2, F.array().cast("array<string>"))
            .when(key % 31 == 3, F.array(F.lit("other")))
            .otherwise(F.col("scopes")),
        )
        .withColumn("status", F.when(key % 37 == 4, "draft").otherwise(F.col("status")))
    )


@query("constraint_violations", f"{_BAD} {_DOCUMENT_VIOLATIONS}")
def constraint_violations(spark, sf_dir):
    return S.document_violations(bad_registry(spark, sf_dir), X.SCOPES)


# every line is a passage here, repeated lines included; vectors come from the embeddings table
_RAW = """
raw AS (
  SELECT c.document_id || '/' || n AS chunk_id, c.document_id, sha256(line) AS content_sha256, e.embedding
  FROM (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) c
  LEFT JOIN embeddings e ON e.vec_id = c.document_id),
kept AS (SELECT * FROM bad WHERE document_id % 41 <> 6)"""
_CHUNK_VIOLATIONS = """
SELECT 'document_content' AS "constraint", document_id || '/' || content_sha256 AS subject FROM raw
GROUP BY document_id, content_sha256 HAVING count(*) > 1
UNION ALL SELECT 'document_reference', CAST(chunk_id AS VARCHAR) FROM raw WHERE document_id NOT IN (SELECT document_id FROM kept)
UNION ALL SELECT 'embedding', CAST(chunk_id AS VARCHAR) FROM raw WHERE embedding IS NULL OR len(embedding) <> 64"""


def raw_chunks(spark, sf_dir):
    vectors = X.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    lines = X.documents(spark, sf_dir).select(
        "document_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")
    )
    return lines.select(
        F.concat_ws("/", F.col("document_id").cast("string"), F.col("n").cast("string")).alias("chunk_id"),
        "document_id",
        F.sha2("line", 256).alias("content_sha256"),
    ).join(vectors, "document_id", "left")


@query("chunk_violations", f"{_BAD}, {_RAW} {_CHUNK_VIOLATIONS}")
def chunk_violations(spark, sf_dir):
    kept = bad_registry(spark, sf_dir).filter("document_id % 41 <> 6")
    return S.chunk_violations(raw_chunks(spark, sf_dir), kept, X.DIMENSION)


@query(
    "check_corpus",
    f"{_BAD.replace('bad AS', 'every AS')}, bad AS (SELECT * FROM every WHERE document_id % 41 <> 6), {_RAW} "
    f"{_DOCUMENT_VIOLATIONS} UNION ALL {_CHUNK_VIOLATIONS} UNION ALL "
    "SELECT DISTINCT 'stale_chunks', CAST(document_id AS VARCHAR) FROM raw JOIN kept USING (document_id) WHERE status <> 'active'",
)
def check_corpus(spark, sf_dir):
    kept = bad_registry(spark, sf_dir).filter("document_id % 41 <> 6")
    return S.check_corpus(kept, raw_chunks(spark, sf_dir), X.DIMENSION, X.SCOPES)
