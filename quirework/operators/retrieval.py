"""Hybrid retrieval: dense and lexical rankings fused by reciprocal rank, hits made citable."""

from pyspark.sql import DataFrame, functions as F

from quirework.functions import text as T
from quirework.functions.common import BROADCAST_MAX_ROWS, fits_broadcast, materialize
from quirework.operators.dense import dense_topk
from quirework.operators.lexical import lexical_topk, postings_topk, top_k
from quirework.operators.refusals import split_unmapped, unmapped_codes

# Candidates per question, and the constant of reciprocal-rank fusion.
CANDIDATES = 20
RRF_K = 60


def reciprocal_rank_fusion(
    rankings: list[DataFrame], k: int = CANDIDATES, constant: int = RRF_K, digits: int = 9
) -> DataFrame:
    """Sum of 1 / (constant + rank) over the rankings a chunk appears in.

    A union and a grouped sum instead of an outer join: one shuffle of at most k rows per
    question and ranking. The score says nothing about relevance.
    """
    merged = rankings[0].select("question_id", "chunk_id", "rank")
    for ranking in rankings[1:]:
        merged = merged.unionByName(ranking.select("question_id", "chunk_id", "rank"))
    fused = merged.groupBy("question_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), digits).alias("score")
    )
    return top_k(fused, k).withColumnRenamed("score", "fusion_score")


def hydrate(
    hits: DataFrame, chunks: DataFrame, documents: DataFrame, hits_bounded: bool = False
) -> DataFrame:
    """Attach content and citation fields; a hit whose chunk is gone is dropped and the
    ranks of the others stay. With few hits the chunk table is scanned, not shuffled."""
    hits = F.broadcast(hits) if hits_bounded else hits
    passages = chunks.select("chunk_id", "document_id", "page_number", "section", "content").join(
        hits, "chunk_id"
    )
    cited = documents.select("document_id", "edition_year_be", "title_th", "source")
    return passages.join(cited, "document_id").select(
        "question_id",
        "rank",
        "fusion_score",
        "chunk_id",
        "document_id",
        "page_number",
        "section",
        "content",
        "edition_year_be",
        "title_th",
        "source",
    )


def hits_fit(questions: DataFrame, k: int) -> bool:
    """At most k hits per question, so the question count bounds the hits."""
    return fits_broadcast(questions.select("question_id"), max_rows=BROADCAST_MAX_ROWS // k)


def refused_questions(questions: DataFrame) -> DataFrame:
    """(question_id, codes) of questions that ``retrieve`` doesn't search for: private-use codes without a repair."""
    return unmapped_codes(questions, "question_id", ["question"])


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    embedder,
    k: int = CANDIDATES,
    lexical_rank: str = "cover",
    index: DataFrame | None = None,
) -> DataFrame:
    """Passages for every question; ``chunks`` carries content and embedding, ``index`` the stored postings.

    No status or edition filter belongs here: promotion removed what must not be found.
    Embedded questions are written once, so the model sees each of them once. Questions with a code
    that no repair maps are refused before any search: ``refused_questions`` has them as rows.
    """
    clean, _ = split_unmapped(questions.select("question_id", "question"), "question_id", ["question"])
    asked = materialize(
        clean.withColumn("normalized", T.normalize_query(F.col("question")))
        .filter(F.col("normalized") != "")
        .withColumn("embedding", embedder(T.tokenize(F.col("normalized")))),
        "questions",
    )
    dense = dense_topk(asked, chunks, k)
    lexical = lexical_topk(asked, chunks, k, lexical_rank) if index is None else postings_topk(asked, index, k, lexical_rank)
    fused = reciprocal_rank_fusion([dense, lexical], k)
    return hydrate(fused, chunks, documents, hits_fit(questions, k))
