"""Normalisation, tokens and scalar functions over whole texts."""

from pyspark.sql import functions as F

from quirework.functions import text as T, vectors as V
from quirework.operators.pages import survey_pua
from quirework.operators.tables import clean_cell
from quirework.plans import fixtures as X
from quirework.plans.catalog import query


@query("collapse_whitespace", f"SELECT doc_id, {X.sql_collapse(X.MESSY_SQL)} AS text FROM documents")
def collapse_whitespace(spark, sf_dir):
    docs = X.load(spark, sf_dir, "documents")
    return docs.select("doc_id", T.collapse_whitespace(X.messy_text()).alias("text"))


@query(
    "flatten_whitespace",
    f"SELECT doc_id, regexp_replace({X.MESSY_SQL}, '\\s+', ' ', 'g') AS text FROM documents",
)
def flatten_whitespace(spark, sf_dir):
    docs = X.load(spark, sf_dir, "documents")
    return docs.select("doc_id", T.flatten_whitespace(X.messy_text()).alias("text"))


@query(
    "running_key",
    f"WITH {X.PAGES_CTE} SELECT document_id, page_number, CAST(n AS INTEGER) AS line_number, "
    f"{X.sql_key('line')} AS running_key FROM page_lines",
)
def running_key(spark, sf_dir):
    lines = X.pages(spark, sf_dir).select(
        "document_id", "page_number", F.posexplode(T.split_lines(F.col("raw_text"))).alias("n", "line")
    )
    return lines.select(
        "document_id",
        "page_number",
        (F.col("n") + 1).alias("line_number"),
        T.running_key(F.col("line")).alias("running_key"),
    )


@query(
    "nfc_normalize",
    "SELECT doc_id, nfc_normalize(replace(replace(replace(text, 'é', 'e' || chr(769)), "
    "'ñ', 'n' || chr(771)), 'ç', 'c' || chr(807))) AS text FROM documents",
)
def nfc_normalize(spark, sf_dir):
    split_marks = F.col("text")
    for letter, pair in (("é", "é"), ("ñ", "ñ"), ("ç", "ç")):
        split_marks = F.replace(split_marks, F.lit(letter), F.lit(pair))
    docs = X.load(spark, sf_dir, "documents")
    return docs.select("doc_id", T.to_nfc(split_marks).alias("text"))


@query(
    "pua_repair",
    f"WITH {X.PAGES_CTE} SELECT document_id, page_number, "
    f"translate({X.PUA_SQL.format(x='raw_text')}, chr(63242) || chr(63248) || chr(63256) || chr(63258), "
    "chr(3656) || chr(3636) || chr(3640) || chr(3642)) AS text FROM doc_pages",
)
def pua_repair(spark, sf_dir):
    return X.pua_pages(spark, sf_dir).select(
        "document_id", "page_number", T.restore_pua(F.col("raw_text")).alias("text")
    )


@query(
    "pua_survey",
    f"WITH {X.PAGES_CTE} SELECT CASE ch WHEN chr(63242) THEN 'U+F70A' WHEN chr(63248) THEN 'U+F710' "
    "WHEN chr(63239) THEN 'U+F707' WHEN chr(63256) THEN 'U+F718' ELSE 'U+F71A' END AS codepoint, "
    "count(*) AS occurrences, ch <> chr(63239) AS mapped FROM ("
    f"SELECT unnest(regexp_extract_all({X.PUA_SQL.format(x='raw_text')}, '[\\x{{f700}}-\\x{{f71a}}]')) AS ch "
    "FROM doc_pages) GROUP BY ch",
)
def pua_survey(spark, sf_dir):
    return survey_pua(X.pua_pages(spark, sf_dir))


@query(
    "script_majority",
    "SELECT doc_id, len(regexp_extract_all(text, '[aeiou]')) > len(regexp_extract_all(text, '[hnrst]')) "
    "AS first_script FROM documents",
)
def script_majority(spark, sf_dir):
    docs = X.load(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", T.script_majority(F.col("text"), "[aeiou]", "[hnrst]").alias("first_script")
    )


@query(
    "tokenize",
    f"SELECT doc_id, array_to_string({X.sql_tokens('text')}, ' ') AS tokens, "
    f"len({X.sql_tokens('text')}) AS n_tokens FROM documents",
)
def tokenize(spark, sf_dir):
    tokens = T.tokenize(F.col("text"))
    return X.load(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("bigint").alias("n_tokens")
    )


@query(
    "normalize_query",
    f"WITH {X.QUESTIONS_CTE} SELECT question_id, {X.sql_collapse('nfc_normalize(question)')} AS question FROM questions",
)
def normalize_query(spark, sf_dir):
    return X.questions(spark, sf_dir).select(
        "question_id", T.normalize_query(F.col("question")).alias("question")
    )


@query(
    "clean_cells",
    f"SELECT doc_id, regexp_replace({X.sql_strip(f'replace({X.MESSY_SQL}, chr(124), chr(92) || chr(124))')}, "
    "'\\s+', ' ', 'g') AS cell FROM documents",
)
def clean_cells(spark, sf_dir):
    docs = X.load(spark, sf_dir, "documents")
    return docs.select("doc_id", clean_cell(X.messy_text()).alias("cell"))


@query(
    "codepoint_labels",
    "SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform("
    "regexp_extract_all(text, '[^\\x00-\\x7f]'), lambda c: printf('U+%04X', unicode(c))))), ' ') AS labels "
    "FROM documents",
)
def codepoint_labels(spark, sf_dir):
    labels = T.codepoint_labels(F.col("text"), r"[^\x00-\x7f]")
    return X.load(spark, sf_dir, "documents").select("doc_id", F.array_join(labels, " ").alias("labels"))


@query(
    "scope_parse",
    "WITH parts AS (SELECT doc_id, unnest([lang || ', ' || source, ' ,' || source, lang || ',']) AS value, "
    "unnest([1, 2, 3]) AS v FROM documents), "
    "scopes AS (SELECT doc_id, v, trim(unnest(string_split(value, ','))) AS scope, "
    "generate_subscripts(string_split(value, ','), 1) AS p FROM parts), "
    "firsts AS (SELECT doc_id, scope, min(v * 100 + p) AS pos FROM scopes WHERE scope <> '' GROUP BY ALL) "
    "SELECT doc_id, string_agg(scope, ',' ORDER BY pos) AS scopes FROM firsts GROUP BY doc_id",
)
def scope_parse(spark, sf_dir):
    values = F.array(
        F.concat("lang", F.lit(", "), "source"), F.concat(F.lit(" ,"), "source"), F.concat("lang", F.lit(","))
    )
    return X.load(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(T.parse_scopes(values), ",").alias("scopes")
    )


@query(
    "scope_validate",
    f"WITH {X.REGISTRY_CTE}, each_scope AS (SELECT document_id, unnest(scopes) AS scope FROM registry) "
    "SELECT document_id, string_agg(scope, ',' ORDER BY scope) AS unknown FROM each_scope "
    "WHERE scope LIKE '%-es' OR scope LIKE '%-de' GROUP BY 1",
)
def scope_validate(spark, sf_dir):
    allowed = [s for s in X.SCOPES if not s.endswith(("-es", "-de"))]
    unknown = T.unknown_scopes(F.col("scopes"), allowed)
    return (
        X.registry(spark, sf_dir)
        .select("document_id", unknown.alias("u"))
        .filter(F.size("u") > 0)
        .select("document_id", F.array_join("u", ",").alias("unknown"))
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def content_hash(spark, sf_dir):
    return X.load(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("content_sha256"))


@query(
    "cosine_similarity",
    "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) "
    "AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosine_similarity(spark, sf_dir):
    vectors = X.load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round(V.cosine_similarity(F.col("embedding"), F.col("following")), 6).alias("similarity")
    )


@query(
    "embedding_dimension",
    "SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64",
)
def embedding_dimension(spark, sf_dir):
    vectors = X.load(spark, sf_dir, "embeddings")
    return vectors.filter(V.wrong_dimension(F.col("embedding"), X.DIMENSION)).select("vec_id")
