"""Explicit schemas of the corpus tables; nothing is inferred at read time."""

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"

PAGES = "document_id string, ordinal int, page_number int, raw_text string"
BLOCKS = f"document_id string, ordinal int, page_number int, bbox {BBOX}, text string"
TABLES = (
    f"document_id string, ordinal int, page_number int, bbox {BBOX}, "
    "row_count int, col_count int, cells array<array<string>>, markdown string"
)
DOCUMENT_META = (
    "file_hash string, source string, title_th string, edition_year_be smallint, "
    "scopes array<string>, page_count int"
)
QA_RECORD = "map<string,struct<passed:boolean,measured:string,threshold:double>>"
DOCUMENTS = (
    "document_id string, source string, title_th string, edition_year_be smallint, "
    "scopes array<string>, status string, file_hash string, page_count int, chunk_count bigint, "
    f"parser string, embedding_model string, qa {QA_RECORD}, "
    "ingested_at timestamp, archived_at timestamp"
)
CHUNKS = (
    "chunk_id string, document_id string, page_number int, kind_rank int, position int, part int, "
    "section string, kind string, content string, content_sha256 string, tokens array<string>, embedding array<float>"
)
QUESTIONS = (
    "id string, question string, answerable boolean, expect_contains string, expect_section string"
)
ATTACKS = (
    "id string, kind string, question string, expect string, must_not_contain array<string>, "
    "expect_contains string, expect_section string"
)
SCORER_RESPONSES = "question_id string, results array<struct<index:int,relevance_score:double>>"
ATTEMPTS = "question_id string, attempt int, reply string, judge_reply string"
REQUEST_LOG = "event_id bigint, ts timestamp, key string"
OBJECT_LISTING = "object_name string, size bigint"

# Scopes and states a document may have.
ALLOWED_SCOPES = ["fungicide", "insecticide", "herbicide"]
STATUSES = ["pending", "active", "archived"]
