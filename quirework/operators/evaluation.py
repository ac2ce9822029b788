"""Offline evaluation: retrieval quality, threshold sweep, answer and attack summaries."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions import text as T
from quirework.operators.ordered import running_sums, with_following
from quirework.operators.rerank import SCORE_THRESHOLD, TOP_K, rerank


def is_expected(content: Column, section: Column, expect_contains: Column, expect_section: Column) -> Column:
    """The golden rule: expected text in the flattened content and the same section, where a
    missing section equals a missing section."""
    return F.contains(T.flatten_whitespace(content), expect_contains) & section.eqNullSafe(expect_section)


def flag_hits(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """Add ``hit`` to scored passages of answerable questions."""
    gold = questions.select("question_id", "answerable", "expect_contains", "expect_section")
    hit = is_expected(
        F.col("content"), F.col("section"), F.col("expect_contains"), F.col("expect_section")
    )
    return (
        scored.join(gold, "question_id")
        .withColumn("hit", F.col("answerable") & F.coalesce(hit, F.lit(False)))
        .drop("expect_contains", "expect_section", "answerable")
    )


def retrieval_outcomes(
    flagged: DataFrame, questions: DataFrame, threshold: float = SCORE_THRESHOLD, top_k: int = TOP_K
) -> DataFrame:
    """(question_id, answerable, n_kept, hit_rank) after the cut; questions without candidates stay."""
    kept = rerank(flagged, threshold, top_k)
    per_question = kept.groupBy("question_id").agg(
        F.count("*").alias("n_kept"),
        F.min(F.when(F.col("hit"), F.col("number"))).alias("hit_rank"),
    )
    return (
        questions.select("question_id", "answerable")
        .join(per_question, "question_id", "left")
        .withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    )


def retrieval_summary(outcomes: DataFrame) -> DataFrame:
    """recall@k and MRR over answerable questions, refusal rate over the others."""
    answerable = F.col("answerable")
    return outcomes.agg(
        F.count_if(answerable).alias("n_answerable"),
        F.count_if(~answerable).alias("n_unanswerable"),
        F.round(F.avg(F.when(answerable, F.col("hit_rank").isNotNull().cast("int"))), 6).alias("recall"),
        F.round(
            F.avg(F.when(answerable, F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)))), 6
        ).alias("mrr"),
        F.round(F.avg(F.when(~answerable, (F.col("n_kept") == 0).cast("int"))), 6).alias("refusal_rate"),
    )


def candidate_thresholds(scored: DataFrame) -> DataFrame:
    """0, the midpoints of neighbouring distinct scores, and a value above the maximum.

    Scores are dealt into ranges at sampled quantiles, so any distribution spreads; neighbours across a
    border are found from one smallest score per range.
    """
    neighbours = with_following(scored.filter("score IS NOT NULL").select("score").distinct(), "score", "upper", "scores")
    middles = neighbours.filter(F.col("upper").isNotNull()).select(((F.col("score") + F.col("upper")) / 2).alias("threshold"))
    zero = scored.sparkSession.range(1).select(F.lit(0.0).alias("threshold"))
    top = scored.agg(F.max("score").alias("top")).filter("top is not null")
    return zero.unionByName(middles).unionByName(top.select((F.col("top") + 1e-6).alias("threshold")))


def threshold_sweep(
    flagged: DataFrame, questions: DataFrame, thresholds: DataFrame, top_k: int = TOP_K
) -> DataFrame:
    """(threshold, positives_kept, negatives_refused) for every threshold.

    The kept list is a prefix of the ranked list, so a positive survives exactly the
    thresholds up to the score of its best-ranked hit within top_k, and a negative is
    refused exactly above its best score. Both are running counts over ordered values; no
    threshold is paired with a question. The order is cut into ranges at sampled quantiles, each
    counted alone and shifted by the totals of those before it.
    """
    ranked = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank")
    best = (
        flagged.withColumn("number", F.row_number().over(ranked))
        .filter(F.col("number") <= top_k)
        .groupBy("question_id")
        .agg(F.max("score").alias("best"), F.max(F.when(F.col("hit"), F.col("score"))).alias("best_hit"))
    )
    per_question = questions.select("question_id", "answerable").join(best, "question_id", "left")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    marks = (
        per_question.select(
            F.when(F.col("answerable"), F.col("best_hit"))
            .otherwise(F.coalesce("best", F.lit(float("-inf"))))
            .alias("value"),
            F.when(F.col("answerable"), one).otherwise(zero).alias("pos"),
            F.when(~F.col("answerable"), one).otherwise(zero).alias("neg"),
            F.lit(False).alias("wanted"),
        )
        .filter(F.col("value").isNotNull())
        .unionByName(
            thresholds.select(
                F.col("threshold").alias("value"), zero.alias("pos"), zero.alias("neg"), F.lit(True).alias("wanted")
            )
        )
        .groupBy("value")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("wanted").alias("wanted"))
    )
    placed = running_sums(marks, {"pos_before": "pos", "neg_before": "neg"}, [F.col("value")], name="marks")
    all_positives = per_question.agg(F.count_if(F.col("answerable") & F.col("best_hit").isNotNull()).alias("pos_total"))
    return (
        placed.filter("wanted")
        .join(F.broadcast(all_positives))
        .select(
            F.col("value").alias("threshold"),
            (F.col("pos_total") - F.col("pos_before")).alias("positives_kept"),
            F.col("neg_before").alias("negatives_refused"),
        )
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Never give up recall, then refuse most negatives, then the lowest threshold."""
    return sweep.orderBy(F.desc("positives_kept"), F.desc("negatives_refused"), "threshold").limit(1)


def answer_summary(results: DataFrame) -> DataFrame:
    """Counts over (answerable, refused, cited_ok, in_language, verdicts) rows."""
    answered = F.col("answerable") & ~F.col("refused")
    doubted = F.exists("verdicts", lambda v: ~F.coalesce(v, F.lit(False)))
    judged_no = F.size(F.filter("verdicts", lambda v: ~F.coalesce(v, F.lit(True))))
    unreadable = F.size(F.filter("verdicts", lambda v: v.isNull()))
    return results.agg(
        F.count_if(F.col("answerable")).alias("n_answerable"),
        F.count_if(answered).alias("answered"),
        F.count_if(answered & F.col("cited_ok")).alias("cited_ok"),
        F.count_if(answered & F.col("in_language")).alias("in_language"),
        F.count_if(F.col("answerable") & F.col("refused") & doubted).alias("refused_by_judge"),
        F.count_if(~F.col("answerable")).alias("n_unanswerable"),
        F.count_if(~F.col("answerable") & F.col("refused")).alias("negatives_refused"),
        F.coalesce(F.sum(F.size("verdicts")), F.lit(0)).alias("judge_calls"),
        F.coalesce(F.sum(judged_no), F.lit(0)).alias("judged_not_grounded"),
        F.coalesce(F.sum(unreadable), F.lit(0)).alias("judged_unreadable"),
    )


def attack_summary(results: DataFrame) -> DataFrame:
    """Passed and total for attacks and for benign look-alikes."""
    group = F.when(F.col("kind") == "benign_lookalike", "benign").otherwise("attack")
    return results.groupBy(group.alias("group")).agg(
        F.count("*").alias("n"), F.count_if(F.col("passed")).alias("n_passed")
    )
