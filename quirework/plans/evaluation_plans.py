"""Retrieval evaluation: outcomes, summary, threshold sweep and choice."""

from pyspark.sql import functions as F

from quirework.functions.common import materialize
from quirework.operators import evaluation as E
from quirework.plans import fixtures as X
from quirework.plans.catalog import query
from quirework.plans.retrieval_plans import _DENSE, vector_neighbours
from quirework.sources.readers import with_answerable

_T = 0.58

# every vector asks for a passage of the next label; a third of the labels has no answer
_GOLD = f"""WITH {_DENSE},
gold AS (
  SELECT vec_id AS question_id, label % 3 <> 0 AS answerable, 'label ' || ((label + 1) % 10) AS expect_contains,
         CASE WHEN label % 2 = 0 THEN 'odd' END AS expect_section FROM embeddings),
scored AS (
  SELECT d.question_id, d.chunk_id, d.rank, (1 + d.score) / 2 AS score, answerable,
         answerable AND contains(regexp_replace('label' || chr(10) || ' ' || d.label, '\\s+', ' ', 'g'), expect_contains)
           AND (CASE WHEN d.label % 2 = 1 THEN 'odd' END IS NOT DISTINCT FROM expect_section) AS hit
  FROM dense d JOIN gold USING (question_id) WHERE d.chunk_id <> d.question_id)"""

_OUTCOMES = f"""{_GOLD},
kept AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS number
  FROM scored WHERE score >= {_T} QUALIFY number <= 5),
per_question AS (
  SELECT g.question_id, g.answerable, count(k.chunk_id) AS n_kept, min(number) FILTER (WHERE hit) AS hit_rank
  FROM gold g LEFT JOIN kept k ON k.question_id = g.question_id GROUP BY 1, 2)"""

_THRESHOLDS = """,
levels AS (SELECT score, lead(score) OVER (ORDER BY score) AS above FROM (SELECT DISTINCT score FROM scored)),
thresholds AS (
  SELECT CAST(0 AS DOUBLE) AS threshold UNION ALL SELECT (score + above) / 2 FROM levels WHERE above IS NOT NULL
  UNION ALL SELECT max(score) + 1e-6 FROM levels HAVING max(score) IS NOT NULL)"""

# every question is judged anew at every threshold
_SWEEP = f"""{_GOLD}{_THRESHOLDS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS number FROM scored),
top AS (SELECT * FROM ranked WHERE number <= 5),
judged AS (
  SELECT t.threshold, g.question_id, g.answerable, count(s.chunk_id) AS n_kept, coalesce(bool_or(s.hit), false) AS found
  FROM thresholds t CROSS JOIN gold g LEFT JOIN top s ON s.question_id = g.question_id AND s.score >= t.threshold
  GROUP BY 1, 2, 3),
sweep AS (
  SELECT threshold, count(*) FILTER (WHERE answerable AND found) AS positives_kept,
         count(*) FILTER (WHERE NOT answerable AND n_kept = 0) AS negatives_refused FROM judged GROUP BY 1)"""


def gold(spark, sf_dir):
    label = F.col("label")
    return X.load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("question_id"),
        (label % 3 != 0).alias("answerable"),
        F.concat(F.lit("label "), ((label + 1) % 10).cast("string")).alias("expect_contains"),
        F.when(label % 2 == 0, "odd").alias("expect_section"),
    )


def flagged(spark, sf_dir):
    labels = X.load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("label\n "), F.col("label").cast("string")).alias("content"),
        F.when(F.col("label") % 2 == 1, "odd").alias("section"),
    )
    scored = (
        vector_neighbours(spark, sf_dir)
        .filter("chunk_id <> question_id")
        .withColumn("score", (1 + F.col("score")) / 2)
        .join(labels, "chunk_id")
    )
    return E.flag_hits(scored, gold(spark, sf_dir))


@query("hit_flags", f"{_GOLD} SELECT question_id, chunk_id, hit FROM scored")
def hit_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("question_id", "chunk_id", "hit")


@query(
    "retrieval_outcomes",
    f"{_OUTCOMES} SELECT question_id, answerable, n_kept, CAST(coalesce(hit_rank, 0) AS INTEGER) AS hit_rank FROM per_question",
)
def retrieval_outcomes(spark, sf_dir):
    outcomes = E.retrieval_outcomes(flagged(spark, sf_dir), gold(spark, sf_dir), _T)
    return outcomes.withColumn("hit_rank", F.coalesce("hit_rank", F.lit(0)))


_SUMMARY = {
    "recall_at_k": "round(avg(CASE WHEN answerable THEN CAST(hit_rank IS NOT NULL AS INTEGER) END), 6) AS recall",
    "mrr": "round(avg(CASE WHEN answerable THEN coalesce(1.0 / hit_rank, 0) END), 6) AS mrr",
    "refusal_rate": "round(avg(CASE WHEN NOT answerable THEN CAST(n_kept = 0 AS INTEGER) END), 6) AS refusal_rate",
}


def _register(name: str, measure: str) -> None:
    column = measure.rsplit(" AS ", 1)[1]

    @query(name, f"{_OUTCOMES} SELECT {measure} FROM per_question")
    def one_measure(spark, sf_dir):
        outcomes = E.retrieval_outcomes(flagged(spark, sf_dir), gold(spark, sf_dir), _T)
        return E.retrieval_summary(outcomes).select(column)


for _name, _measure in _SUMMARY.items():
    _register(_name, _measure)


@query("threshold_candidates", f"{_GOLD}{_THRESHOLDS} SELECT threshold FROM thresholds")
def threshold_candidates(spark, sf_dir):
    return E.candidate_thresholds(flagged(spark, sf_dir))


def _sweep(spark, sf_dir):
    scored = materialize(flagged(spark, sf_dir), "scored")  # scored once, cut at every threshold
    return E.threshold_sweep(scored, gold(spark, sf_dir), E.candidate_thresholds(scored))


@query("threshold_sweep", f"{_SWEEP} SELECT threshold, positives_kept, negatives_refused FROM sweep")
def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(
    "best_threshold",
    f"{_SWEEP} SELECT threshold, positives_kept, negatives_refused FROM sweep "
    "ORDER BY positives_kept DESC, negatives_refused DESC, threshold LIMIT 1",
)
def best_threshold(spark, sf_dir):
    return E.best_threshold(_sweep(spark, sf_dir))


# the labels table as truth: quality 1 should be kept, 0 refused, by a share-of-letters score
_LABEL_SCORE = "round(len(regexp_extract_all(text, '[A-Za-z]')) / len(text), 6)"
_LABELLED = f"""WITH scored AS (
  SELECT doc_id, quality = 1 AS answerable, {_LABEL_SCORE} AS score FROM labels JOIN documents USING (doc_id))"""


@query(
    "label_threshold_sweep",
    f"{_LABELLED}{_THRESHOLDS} SELECT threshold, count(*) FILTER (WHERE answerable AND score >= threshold) AS positives_kept, "
    "count(*) FILTER (WHERE NOT answerable AND score < threshold) AS negatives_refused "
    "FROM thresholds CROSS JOIN scored GROUP BY 1",
)
def label_threshold_sweep(spark, sf_dir):
    share = F.round(F.regexp_count("text", F.lit("[A-Za-z]")) / F.length("text"), 6)
    texts = X.load(spark, sf_dir, "documents").select("doc_id", share.alias("score"))
    labels = X.load(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("answerable")
    )
    joined = texts.join(labels, F.col("doc_id") == F.col("question_id")).select(
        "question_id", "score", F.lit(1).alias("rank"), F.col("answerable").alias("hit")
    )
    scored = materialize(joined, "scored")
    return E.threshold_sweep(scored, labels, E.candidate_thresholds(scored))


@query(
    "attack_set",
    "SELECT conv_id, turn, expect, expect = 'answer' AS answerable FROM (SELECT conv_id, turn, "
    "CASE turn % 3 WHEN 0 THEN 'refuse' WHEN 1 THEN 'refuse_or_grounded' ELSE 'answer' END AS expect "
    "FROM conversations WHERE role = 'user')",
)
def attack_set(spark, sf_dir):
    turn = F.col("turn") % 3
    asked = X.load(spark, sf_dir, "conversations").filter("role = 'user'")
    cases = asked.select(
        "conv_id",
        "turn",
        F.when(turn == 0, "refuse").when(turn == 1, "refuse_or_grounded").otherwise("answer").alias("expect"),
    )
    return with_answerable(cases)
