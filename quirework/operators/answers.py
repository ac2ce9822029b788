"""From reranked passages to a served answer or a refusal."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirework.functions import replies as R
from quirework.functions.common import materialize
from quirework.functions.pii import has_pii

# Fixed value: one attempt and one retry.
MAX_ATTEMPTS = 2


def _in_order(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("number", *fields)))


def build_prompts(kept: DataFrame, questions: DataFrame, instructions: str) -> DataFrame:
    """(question_id, question, prompt, n_passages, passages) of questions that kept passages.

    At most ``top_k`` passages are gathered per question. A question without passages gets
    no prompt at all.
    """
    gathered = kept.groupBy("question_id").agg(
        _in_order("chunk_id", "section", "content", "score").alias("passages")
    )
    blocks = F.transform(
        "passages", lambda p: R.passage_block(p["number"], p["section"], p["content"])
    )
    ask = F.concat(F.lit("Question: "), F.col("question"))
    return gathered.join(questions.select("question_id", "question"), "question_id").select(
        "question_id",
        "question",
        F.array_join(F.concat(F.array(F.lit(instructions)), blocks, F.array(ask)), "\n\n").alias("prompt"),
        F.size("passages").alias("n_passages"),
        "passages",
    )


def cited_passages(citations: Column, passages: Column) -> Column:
    """Passages of the cited numbers in citation order; numbers count from 1."""
    return F.transform(citations, lambda n: F.get(passages, n - 1))


def grounding_prompt(question: Column, answer: Column, cited: Column, instructions: str) -> Column:
    """What the judge sees: instructions, cited excerpts under their numbers, question, answer."""
    excerpts = F.transform(cited, lambda p: R.passage_block(p["number"], p["section"], p["content"]))
    return F.array_join(
        F.concat(
            F.array(F.lit(instructions)),
            excerpts,
            F.array(F.concat(F.lit("Question: "), question), F.concat(F.lit("Answer: "), answer)),
        ),
        "\n\n",
    )


def attempt_state(reply: Column, verdict: Column) -> Column:
    """State of one attempt: answered, refused, pii, undecided, or a retry as invalid or
    ungrounded. ``reply`` is the parsed struct, ``verdict`` the three-valued judgement."""
    return (
        F.when(~reply["valid"], "invalid")
        .when(F.size(reply["citations"]) == 0, "refused")
        .when(verdict.isNull(), "undecided")
        .when(~verdict, "ungrounded")
        .when(has_pii(reply["answer"]), "pii")
        .otherwise("answered")
    )


def evaluate_attempts(attempts: DataFrame) -> DataFrame:
    """Add parsed reply, verdict and state to (question_id, attempt, reply, judge_reply, n_passages)."""
    return (
        attempts.withColumn("parsed", R.parse_reply(F.col("reply"), F.col("n_passages")))
        .withColumn("verdict", R.parse_verdict(F.col("judge_reply")))
        .withColumn("state", attempt_state(F.col("parsed"), F.col("verdict")))
    )


def _final(state: Column) -> Column:
    return ~state.isin("invalid", "ungrounded")


def resolve_attempts(
    questions: DataFrame, evaluated: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """(question_id, text, citations, state): the first final attempt decides.

    A question with personal data is refused before anything else; one without a final
    attempt is refused. The pick is a grouped minimum, combined before the shuffle.
    """
    first = (
        evaluated.filter(F.col("attempt") <= max_attempts)
        .filter(_final(F.col("state")))
        .groupBy("question_id")
        .agg(
            F.min_by(F.struct("state", "parsed.answer", "parsed.citations"), "attempt").alias("d")
        )
    )
    state = F.when(has_pii(F.col("question")), "pii").otherwise(F.coalesce("d.state", F.lit("refused")))
    served = F.col("state") == "answered"
    return (
        questions.select("question_id", "question")
        .join(first, "question_id", "left")
        .withColumn("state", state)
        .select(
            "question_id",
            F.when(served, F.col("d.answer"))
            .when(F.col("state") == "pii", R.PII_REFUSAL_TEXT)
            .otherwise(R.REFUSAL_TEXT)
            .alias("text"),
            F.when(served, F.col("d.citations"))
            .otherwise(F.array().cast("array<int>"))
            .alias("citations"),
            "state",
        )
    )


def judged_verdicts(evaluated: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(question_id, verdicts) of the judge calls made: attempts with citations, up to the
    first final one. At most ``max_attempts`` rows per question are gathered."""
    first_final = F.min(F.when(_final(F.col("state")), F.col("attempt"))).over(
        Window.partitionBy("question_id")
    )
    in_order = F.array_sort(F.collect_list(F.struct("attempt", "verdict")))
    return (
        evaluated.filter(F.col("attempt") <= max_attempts)
        .withColumn("last", F.coalesce(first_final, F.lit(max_attempts)))
        .filter(F.col("attempt") <= F.col("last"))
        .filter(~F.col("state").isin("invalid", "refused"))
        .groupBy("question_id")
        .agg(F.transform(in_order, lambda a: a["verdict"]).alias("verdicts"))
    )


def answer(
    questions: DataFrame,
    kept: DataFrame,
    chat,
    judge,
    instructions: str,
    judge_instructions: str,
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Ask, check and decide. ``chat`` and ``judge`` are Column functions from prompt and attempt to reply.

    Each round runs only on questions that still need one and its replies are written to
    the shared folder, so a model is called once per prompt. The judge sees only rows whose
    reply cites something.
    """
    safe = questions.filter(~has_pii(F.col("question")))
    pending = build_prompts(kept, safe, instructions)
    rounds = []
    for attempt in range(1, max_attempts + 1):
        replied = materialize(
            pending.withColumn("attempt", F.lit(attempt)).withColumn("reply", chat(F.col("prompt"), F.lit(attempt))),
            "replies",
        ).withColumn("parsed", R.parse_reply(F.col("reply"), F.col("n_passages")))
        needs_judge = F.col("parsed.valid") & (F.size("parsed.citations") > 0)
        judged = materialize(
            replied.filter(needs_judge)
            .withColumn("cited", cited_passages(F.col("parsed.citations"), F.col("passages")))
            .withColumn(
                "judge_prompt",
                grounding_prompt(
                    F.col("question"), F.col("parsed.answer"), F.col("cited"), judge_instructions
                ),
            )
            .select("question_id", judge(F.col("judge_prompt"), F.lit(attempt)).alias("judge_reply")),
            "verdicts",
        )
        evaluated = evaluate_attempts(
            replied.drop("parsed").join(judged, "question_id", "left")
        )
        rounds.append(
            evaluated.select("question_id", "attempt", "reply", "judge_reply", "parsed", "verdict", "state")
        )
        again = evaluated.filter(~_final(F.col("state"))).select("question_id")
        pending = replied.drop("attempt", "reply", "parsed").join(again, "question_id", "left_semi")
    evaluated = rounds[0]
    for later in rounds[1:]:
        evaluated = evaluated.unionByName(later)
    return resolve_attempts(questions, evaluated, max_attempts)


def approve_all(prompt: Column, attempt: Column) -> Column:
    """Judge for baselines: every answer passes."""
    return F.when(prompt.isNotNull(), '{"unsupported": [], "grounded": true}')
