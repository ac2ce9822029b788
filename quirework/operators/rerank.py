"""Absolute relevance: scorer contract, inclusive threshold, top-k after filter and sort."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions import text as T

# Refusal threshold and passages kept.
SCORE_THRESHOLD = 0.42
TOP_K = 5


def token_overlap_score(question: Column, content: Column) -> Column:
    """Default scorer: share of the question's distinct tokens that the passage holds."""
    asked = F.array_distinct(T.tokenize(question))
    shared = F.size(F.array_intersect(asked, T.tokenize(content)))
    return F.coalesce(F.round(F.try_divide(shared, F.size(asked)), 6), F.lit(0.0))


def contract_violation(results: Column, n_passages: Column) -> Column:
    """Why a scorer response cannot be aligned with its passages; null when it can."""
    indices = F.transform(results, lambda r: r["index"])
    return (
        F.when(results.isNull() | (F.size(results) != n_passages), "count")
        .when(F.size(F.array_distinct(indices)) < F.size(indices), "duplicate index")
        .when(
            F.exists(indices, lambda i: i.isNull() | (i < 0) | (i >= n_passages)),
            "index out of range",
        )
        .when(
            F.exists(
                results,
                lambda r: r["relevance_score"].isNull()
                | (r["relevance_score"] < 0)
                | (r["relevance_score"] > 1),
            ),
            "score out of range",
        )
    )


def scorer_violations(passages: DataFrame, responses: DataFrame) -> DataFrame:
    """(question_id, violation) of responses that break the contract."""
    counts = passages.groupBy("question_id").agg(F.count("*").cast("int").alias("n_passages"))
    return (
        counts.join(responses, "question_id", "left")
        .select("question_id", contract_violation(F.col("results"), F.col("n_passages")).alias("violation"))
        .filter(F.col("violation").isNotNull())
    )


def align_scores(passages: DataFrame, responses: DataFrame) -> DataFrame:
    """Add ``score`` by the index each result names: the passage's position by rank, from 0.

    A question with any violation keeps no passage.
    """
    by_rank = Window.partitionBy("question_id").orderBy("rank")
    positioned = passages.withColumn("index", F.row_number().over(by_rank) - 1)
    broken = scorer_violations(passages, responses).select("question_id")
    scores = responses.select("question_id", F.inline("results")).select(
        "question_id", "index", F.col("relevance_score").alias("score")
    )
    return (
        positioned.join(broken, "question_id", "left_anti")
        .join(scores, ["question_id", "index"])
        .drop("index")
    )


def score_passages(passages: DataFrame, questions: DataFrame, scorer=token_overlap_score) -> DataFrame:
    """Add ``score`` with a pairwise scorer over the raw question and the passage content."""
    raw = questions.select("question_id", "question")
    return (
        passages.join(raw, "question_id")
        .withColumn("score", scorer(F.col("question"), F.col("content")))
        .drop("question")
    )


def rerank(scored: DataFrame, threshold: float = SCORE_THRESHOLD, top_k: int = TOP_K) -> DataFrame:
    """Keep scores at or above the threshold and number the best ``top_k`` by score, then rank.

    ``number`` is the citation number; a question without rows is a refusal.
    """
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank")
    return (
        scored.filter(F.col("score") >= threshold)
        .withColumn("number", F.row_number().over(best))
        .filter(F.col("number") <= top_k)
    )
