"""Personal data, prompts, replies, verdicts and answer evaluation."""

from pyspark.sql import Window, functions as F

from quirework.functions import pii as G, replies as R, text as T
from quirework.operators import answers as A, evaluation as E, rerank as K
from quirework.plans import fixtures as X
from quirework.plans.catalog import query

_INSTRUCTIONS = "Use only the excerpts."
_JUDGE = "Check every claim."
_KEEP = 0.1

_CHECK_DIGIT = (
    "(11 - CAST(list_sum(list_transform(range(12), lambda i: CAST(substr({d}, CAST(i AS INTEGER) + 1, 1) AS INTEGER) "
    "* (13 - i))) AS INTEGER) % 11) % 10"
)
_ID_REGEX = "(?:^|[^0-9])((?:[0-9][- ]?){12}[0-9])(?:[^0-9]|$)"


def _kinds_sql(x: str) -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    valid = f"{_CHECK_DIGIT.format(d=digits)} = CAST(substr({digits}, 13, 1) AS INTEGER)"
    return (
        "array_to_string(list_filter(["
        f"CASE WHEN regexp_matches({x}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') THEN 'email' END, "
        f"CASE WHEN len(list_filter(regexp_extract_all({x}, '{_ID_REGEX}', 1), lambda m: {valid})) > 0 "
        "THEN 'thai_national_id' END, "
        f"CASE WHEN regexp_matches({x}, '(^|[^0-9])0([- ]?[0-9]){{8,9}}([^0-9]|$)') THEN 'thai_phone' END"
        "], lambda k: k IS NOT NULL), ',')"
    )


# an identity number with a right or wrong check digit, or a phone number, follows each text
_MARKED_SQL = (
    "text || CASE doc_id % 3 WHEN 2 THEN ' call 02-555-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') "
    "ELSE ' id ' || CAST(100000000000 + doc_id * 7919 AS VARCHAR) || '-' || CAST(("
    + _CHECK_DIGIT.format(d="CAST(100000000000 + doc_id * 7919 AS VARCHAR)")
    + " + doc_id % 3) % 10 AS VARCHAR) END || '.'"
)
# some identity numbers are written in the digits of another script, which changes no kind
_SCRIPTS = {1: "٠١٢٣٤٥٦٧٨٩", 2: "０１２３４５６７８９", 3: "๐๑๒๓๔๕๖๗๘๙"}


@query(
    "id_checksum",
    "WITH d AS (SELECT o_orderkey, CAST((100000000000 + o_orderkey * 7919 + o_custkey) * 10 + o_orderkey % 10 AS VARCHAR) AS digits FROM orders) "
    f"SELECT o_orderkey, digits, CAST({_CHECK_DIGIT.format(d='digits')} AS INTEGER) AS check_digit, "
    f"{_CHECK_DIGIT.format(d='digits')} = o_orderkey % 10 AS valid FROM d",
)
def id_checksum(spark, sf_dir):
    key = F.col("o_orderkey")
    digits = ((F.lit(100000000000) + key * 7919 + F.col("o_custkey")) * 10 + key % 10).cast("string")
    return X.load(spark, sf_dir, "orders").select(
        "o_orderkey",
        digits.alias("digits"),
        G.id_check_digit(digits).alias("check_digit"),
        G.has_valid_check_digit(digits).alias("valid"),
    )


@query("pii_documents", f"SELECT doc_id, {_kinds_sql('text')} AS kinds FROM documents")
def pii_documents(spark, sf_dir):
    docs = X.load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(G.find_pii(F.col("text")), ",").alias("kinds"))


@query(
    "pii_marked_documents",
    f"WITH m AS (SELECT doc_id, {_MARKED_SQL} AS text FROM documents) SELECT doc_id, {_kinds_sql('text')} AS kinds FROM m",
)
def pii_marked_documents(spark, sf_dir):
    key = F.col("doc_id")
    twelve = (F.lit(100000000000) + key * 7919).cast("string")
    check = ((G.id_check_digit(twelve) + key % 3) % 10).cast("int").cast("string")
    phone = F.concat(F.lit(" call 02-555-"), F.lpad((key % 10000).cast("string"), 4, "0"))
    number = F.concat(F.lit(" id "), twelve, F.lit("-"), check)
    for k, digits in _SCRIPTS.items():
        number = F.when(key % 5 == k, F.translate(number, "0123456789", digits)).otherwise(number)
    text = F.concat("text", F.when(key % 3 == 2, phone).otherwise(number), F.lit("."))
    docs = X.load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(G.find_pii(text), ",").alias("kinds"))


@query(
    "pii_conversations",
    f"SELECT conv_id, turn, {_kinds_sql('text')} AS kinds FROM conversations",
)
def pii_conversations(spark, sf_dir):
    talk = X.load(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", F.array_join(G.find_pii(F.col("text")), ",").alias("kinds"))


# -- questions are user turns, passages the best of all other turns by shared words, replies the assistant turn after

_GOOD_REPLY = "CAST(to_json({'answer': c.text, 'citations': [1]}) AS VARCHAR)"

_TALK = f"""
questions AS (
  SELECT conv_id || '/' || turn AS question_id, conv_id, turn,
         text || CASE WHEN (conv_id + turn) % 9 = 0 THEN ' call 02-555-0142' ELSE '' END AS question
  FROM conversations WHERE role = 'user'),
candidates AS (
  SELECT q.question_id, c.text AS content, CASE WHEN c.role <> 'user' THEN c.role END AS section,
         row_number() OVER (PARTITION BY q.question_id ORDER BY c.turn, c.role) AS rank,
         coalesce(round(len(list_intersect(list_distinct({X.sql_tokens('q.question')}), {X.sql_tokens('c.text')}))
           / nullif(len(list_distinct({X.sql_tokens('q.question')})), 0), 6), 0) AS score
  FROM questions q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn <> q.turn),
kept AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank) AS INTEGER) AS number
  FROM candidates WHERE score >= {_KEEP} QUALIFY number <= 5),
sizes AS (SELECT question_id, count(*) AS n_passages FROM kept GROUP BY 1),
attempts AS (
  SELECT q.question_id, a.attempt, n_passages,
         CASE (q.conv_id * 3 + q.turn * 5 + a.attempt) % 11
           WHEN 0 THEN c.text
           WHEN 1 THEN CAST(to_json({{'answer': c.text, 'citations': CAST([] AS INTEGER[])}}) AS VARCHAR)
           WHEN 2 THEN CAST(to_json({{'answer': c.text, 'citations': [1, 9]}}) AS VARCHAR)
           WHEN 3 THEN CAST(to_json({{'answer': c.text, 'citations': [1, 1]}}) AS VARCHAR)
           WHEN 4 THEN CAST(to_json({{'answer': c.text, 'citations': [3, 1]}}) AS VARCHAR)
           WHEN 5 THEN CAST(to_json({{'answer': c.text || ' a.b@example.org', 'citations': [1]}}) AS VARCHAR)
           WHEN 6 THEN {_GOOD_REPLY} || ' and more'
           WHEN 7 THEN '```json' || chr(10) || {_GOOD_REPLY} || chr(10) || '```'
           WHEN 8 THEN replace({_GOOD_REPLY}, '"', chr(39))
           WHEN 9 THEN '{{"answer": 5, "citations": [1]}}'
           ELSE {_GOOD_REPLY} END AS reply,
         CASE (q.conv_id + q.turn + a.attempt) % 9
           WHEN 0 THEN '{{"unsupported": ["x"], "grounded": false}}'
           WHEN 1 THEN '{{"grounded": "maybe"}}'
           WHEN 2 THEN 'The answer looks fine.'
           WHEN 3 THEN '{{"grounded": true}} trailing'
           WHEN 4 THEN '{{"grounded": false}}' || chr(10) || '```'
           WHEN 5 THEN '{{''grounded'': true}}'
           ELSE '{{"unsupported": [], "grounded": true}}' END AS judge_reply
  FROM questions q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn = q.turn + 1 AND c.role = 'assistant'
  JOIN sizes USING (question_id), (VALUES (1), (2)) a(attempt)),
numbered AS (
  SELECT *, CASE WHEN json_valid(reply) THEN TRY_CAST(json_extract(reply, '$.citations') AS INTEGER[]) END AS numbers,
         CASE WHEN json_valid(reply) AND json_type(reply, '$.answer') = 'VARCHAR' THEN json_extract_string(reply, '$.answer') END AS said,
         CASE WHEN json_valid(judge_reply) AND json_type(judge_reply, '$.grounded') = 'BOOLEAN'
              THEN CAST(json_extract_string(judge_reply, '$.grounded') AS BOOLEAN) END AS verdict
  FROM attempts),
parsed AS (
  SELECT *, coalesce(len(list_filter(numbers, lambda x: x < 1 OR x > n_passages)) = 0
                     AND (len(numbers) = 0 OR said IS NOT NULL), false) AS valid,
         CASE WHEN numbers = [1, 1] THEN [1] ELSE numbers END AS cited FROM numbered),
evaluated AS (
  SELECT *, CASE WHEN NOT valid THEN 'invalid' WHEN len(numbers) = 0 THEN 'refused' WHEN verdict IS NULL THEN 'undecided'
                 WHEN NOT verdict THEN 'ungrounded' WHEN {_kinds_sql('said')} <> '' THEN 'pii' ELSE 'answered' END AS state
  FROM parsed),
decided AS (
  SELECT * FROM evaluated WHERE state NOT IN ('invalid', 'ungrounded')
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY attempt) = 1),
resolved AS (
  SELECT q.question_id, q.conv_id, q.turn,
         CASE WHEN {_kinds_sql('question')} <> '' THEN 'pii' ELSE coalesce(d.state, 'refused') END AS final_state, d.said, d.cited
  FROM questions q LEFT JOIN decided d USING (question_id)),
answers AS (
  SELECT question_id, conv_id, turn, final_state AS state,
         CASE final_state WHEN 'answered' THEN said WHEN 'pii' THEN '{R.PII_REFUSAL_TEXT}' ELSE '{R.REFUSAL_TEXT}' END AS text,
         CASE WHEN final_state = 'answered' THEN cited ELSE [] END AS citations FROM resolved)"""


def questions(spark, sf_dir):
    number = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, " call 02-555-0142").otherwise("")
    return (
        X.load(spark, sf_dir, "conversations")
        .filter("role = 'user'")
        .select(
            F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
            "conv_id",
            "turn",
            F.concat("text", number).alias("question"),
        )
    )


def kept_passages(spark, sf_dir):
    """All other turns of the question's conversation are candidates; reranking keeps the best five."""
    talk = X.load(spark, sf_dir, "conversations").withColumnRenamed("turn", "at")
    asked = questions(spark, sf_dir)
    order = Window.partitionBy("question_id").orderBy("at", "role")
    candidates = (
        asked.select("question_id", "conv_id", "turn")
        .join(talk, "conv_id")
        .filter("at <> turn")
        .select(
            "question_id",
            F.row_number().over(order).alias("rank"),
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("at").cast("string")).alias("chunk_id"),
            F.when(F.col("role") != "user", F.col("role")).alias("section"),
            F.col("text").alias("content"),
        )
    )
    return K.rerank(K.score_passages(candidates, asked), _KEEP).drop("rank")


def attempts(spark, sf_dir):
    talk = X.load(spark, sf_dir, "conversations").filter("role = 'assistant'")
    spoken = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    sizes = kept_passages(spark, sf_dir).groupBy("question_id").agg(F.count("*").alias("n_passages"))
    base = (
        questions(spark, sf_dir)
        .join(spoken, ["conv_id", "turn"])
        .join(sizes, "question_id")
        .withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    )
    conv, turn, attempt = F.col("conv_id"), F.col("turn"), F.col("attempt")
    kind, mood = (conv * 3 + turn * 5 + attempt) % 11, (conv + turn + attempt) % 9
    numbers = (
        F.when(kind == 1, F.array().cast("array<int>"))
        .when(kind == 2, F.array(F.lit(1), F.lit(9)))
        .when(kind == 3, F.array(F.lit(1), F.lit(1)))
        .when(kind == 4, F.array(F.lit(3), F.lit(1)))
        .otherwise(F.array(F.lit(1)))
    )
    said = F.when(kind == 5, F.concat("said", F.lit(" a.b@example.org"))).otherwise(F.col("said"))
    reply = F.to_json(F.struct(said.alias("answer"), numbers.alias("citations")))
    return base.select(
        "question_id",
        "attempt",
        "n_passages",
        F.when(kind == 0, F.col("said"))
        .when(kind == 6, F.concat(reply, F.lit(" and more")))
        .when(kind == 7, F.concat(F.lit("```json\n"), reply, F.lit("\n```")))
        .when(kind == 8, F.translate(reply, '"', "'"))
        .when(kind == 9, '{"answer": 5, "citations": [1]}')
        .otherwise(reply)
        .alias("reply"),
        F.when(mood == 0, '{"unsupported": ["x"], "grounded": false}')
        .when(mood == 1, '{"grounded": "maybe"}')
        .when(mood == 2, "The answer looks fine.")
        .when(mood == 3, '{"grounded": true} trailing')
        .when(mood == 4, '{"grounded": false}\n```')
        .when(mood == 5, "{'grounded': true}")
        .otherwise('{"unsupported": [], "grounded": true}')
        .alias("judge_reply"),
    )


def _joined(numbers):
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",")


@query(
    "parse_replies",
    f"WITH {_TALK} SELECT question_id, attempt, valid, CASE WHEN NOT valid THEN NULL WHEN len(numbers) = 0 "
    f"THEN '{R.REFUSAL_TEXT}' ELSE said END AS answer, CASE WHEN valid THEN array_to_string(cited, ',') END AS citations FROM parsed",
)
def parse_replies(spark, sf_dir):
    parsed = R.parse_reply(F.col("reply"), F.col("n_passages"))
    return attempts(spark, sf_dir).select("question_id", "attempt", parsed.alias("p")).select(
        "question_id", "attempt", "p.valid", "p.answer", _joined(F.col("p.citations")).alias("citations")
    )


@query(
    "verdicts",
    f"WITH {_TALK} SELECT question_id, attempt, coalesce(CAST(verdict AS VARCHAR), 'undecided') AS verdict FROM parsed",
)
def verdicts(spark, sf_dir):
    verdict = R.parse_verdict(F.col("judge_reply")).cast("string")
    return attempts(spark, sf_dir).select(
        "question_id", "attempt", F.coalesce(verdict, F.lit("undecided")).alias("verdict")
    )


@query("attempt_states", f"WITH {_TALK} SELECT question_id, attempt, state FROM evaluated")
def attempt_states(spark, sf_dir):
    return A.evaluate_attempts(attempts(spark, sf_dir)).select("question_id", "attempt", "state")


@query(
    "resolve_attempts",
    f"WITH {_TALK} SELECT question_id, state, text, array_to_string(citations, ',') AS citations FROM answers",
)
def resolve_attempts(spark, sf_dir):
    evaluated = A.evaluate_attempts(attempts(spark, sf_dir))
    return A.resolve_attempts(questions(spark, sf_dir), evaluated).withColumn(
        "citations", _joined(F.col("citations"))
    )


@query(
    "judged_verdicts",
    f"WITH {_TALK} SELECT e.question_id, string_agg(CASE WHEN e.verdict IS NULL THEN '?' WHEN e.verdict THEN 'T' ELSE 'F' END, '' "
    "ORDER BY e.attempt) AS verdicts FROM evaluated e LEFT JOIN decided d USING (question_id) "
    "WHERE e.attempt <= coalesce(d.attempt, 2) AND e.state NOT IN ('invalid', 'refused') GROUP BY 1",
)
def judged_verdicts(spark, sf_dir):
    called = A.judged_verdicts(A.evaluate_attempts(attempts(spark, sf_dir)))
    return called.select("question_id", R.verdict_string(F.col("verdicts")).alias("verdicts"))


_BLOCK = "'[' || number || '] ' || CASE WHEN section IS NULL THEN '' ELSE '(' || section || ') ' END || content"


@query(
    "prompt_text",
    f"WITH {_TALK} SELECT question_id, n_passages, '{_INSTRUCTIONS}' || chr(10) || chr(10) || "
    f"string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY number) || chr(10) || chr(10) || 'Question: ' || any_value(question) AS prompt "
    "FROM kept JOIN questions USING (question_id) JOIN sizes USING (question_id) GROUP BY 1, 2",
)
def prompt_text(spark, sf_dir):
    prompts = A.build_prompts(kept_passages(spark, sf_dir), questions(spark, sf_dir), _INSTRUCTIONS)
    return prompts.select("question_id", F.col("n_passages").cast("bigint").alias("n_passages"), "prompt")


@query(
    "cited_passages",
    f"WITH {_TALK}, c AS (SELECT question_id, unnest(citations) AS number, generate_subscripts(citations, 1) - 1 AS position FROM answers) "
    "SELECT question_id, CAST(position AS INTEGER) AS position, number, section, content FROM c JOIN kept USING (question_id, number)",
)
def cited_passages(spark, sf_dir):
    """Cited numbers bound to passages by an equi-join on (question, number)."""
    evaluated = A.evaluate_attempts(attempts(spark, sf_dir))
    answered = A.resolve_attempts(questions(spark, sf_dir), evaluated)
    cited = answered.select("question_id", F.posexplode("citations").alias("position", "number"))
    return cited.join(kept_passages(spark, sf_dir), ["question_id", "number"]).select(
        "question_id", "position", "number", "section", "content"
    )


@query(
    "grounding_prompt",
    f"WITH {_TALK}, c AS (SELECT question_id, attempt, said, unnest(cited) AS number, generate_subscripts(cited, 1) AS i "
    "FROM evaluated WHERE valid AND len(numbers) > 0) "
    f"SELECT question_id, attempt, '{_JUDGE}' || chr(10) || chr(10) || string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY i) || "
    "chr(10) || chr(10) || 'Question: ' || any_value(question) || chr(10) || chr(10) || 'Answer: ' || any_value(said) AS prompt "
    "FROM c JOIN kept USING (question_id, number) JOIN questions USING (question_id) GROUP BY 1, 2",
)
def grounding_prompt(spark, sf_dir):
    prompts = A.build_prompts(kept_passages(spark, sf_dir), questions(spark, sf_dir), _INSTRUCTIONS)
    parsed = A.evaluate_attempts(attempts(spark, sf_dir)).filter(
        F.col("parsed.valid") & (F.size("parsed.citations") > 0)
    )
    judged = parsed.join(prompts.select("question_id", "question", "passages"), "question_id")
    cited = A.cited_passages(F.col("parsed.citations"), F.col("passages"))
    return judged.select(
        "question_id",
        "attempt",
        A.grounding_prompt(F.col("question"), F.col("parsed.answer"), cited, _JUDGE).alias("prompt"),
    )


# the gold expectation: the answer must cite a passage of an assistant turn that says " de "
_RESULTS = f"""{_TALK},
calls AS (
  SELECT e.question_id, list(e.verdict ORDER BY e.attempt) AS verdicts FROM evaluated e LEFT JOIN decided d USING (question_id)
  WHERE e.attempt <= coalesce(d.attempt, 2) AND e.state NOT IN ('invalid', 'refused') GROUP BY 1),
cites AS (
  SELECT question_id, bool_or(regexp_replace(content, '\\s+', ' ', 'g') LIKE '% de %' AND section = 'assistant') AS ok
  FROM (SELECT question_id, unnest(citations) AS number FROM answers) JOIN kept USING (question_id, number) GROUP BY 1),
results AS (
  SELECT a.question_id, a.conv_id, a.turn, conv_id % 3 <> 0 AS answerable, text, len(citations) = 0 AS refused, state,
         coalesce(ok, false) AS cited_ok, coalesce(verdicts, []) AS verdicts,
         len(regexp_extract_all(text, '[aeiou]')) > len(regexp_extract_all(text, '[hnrst]')) AS in_language
  FROM answers a LEFT JOIN cites USING (question_id) LEFT JOIN calls USING (question_id))"""
_DOUBTED = "len(list_filter(verdicts, lambda v: v IS DISTINCT FROM true)) > 0"


def results(spark, sf_dir):
    evaluated = A.evaluate_attempts(attempts(spark, sf_dir))
    asked = questions(spark, sf_dir)
    answered = A.resolve_attempts(asked, evaluated)
    prompts = A.build_prompts(kept_passages(spark, sf_dir), asked, _INSTRUCTIONS)
    joined = (
        answered.join(asked.select("question_id", "conv_id", "turn"), "question_id")
        .join(prompts.select("question_id", "passages"), "question_id", "left")
        .join(A.judged_verdicts(evaluated), "question_id", "left")
    )
    expected = F.exists(
        A.cited_passages(F.col("citations"), F.col("passages")),
        lambda p: E.is_expected(p["content"], p["section"], F.lit(" de "), F.lit("assistant")),
    )
    return joined.select(
        "question_id",
        "conv_id",
        "turn",
        (F.col("conv_id") % 3 != 0).alias("answerable"),
        "text",
        (F.size("citations") == 0).alias("refused"),
        F.coalesce(expected, F.lit(False)).alias("cited_ok"),
        F.coalesce("verdicts", F.array().cast("array<boolean>")).alias("verdicts"),
        T.script_majority(F.col("text"), "[aeiou]", "[hnrst]").alias("in_language"),
    )


@query(
    "answer_outcomes",
    f"WITH {_RESULTS} SELECT question_id, cited_ok, in_language, CASE WHEN NOT refused THEN 'answered' "
    f"WHEN state = 'pii' THEN 'refused (pii)' WHEN {_DOUBTED} THEN 'refused (judge)' ELSE 'refused' END AS outcome FROM results",
)
def answer_outcomes(spark, sf_dir):
    outcome = R.outcome(F.col("refused"), F.col("text"), F.col("verdicts"))
    return results(spark, sf_dir).select("question_id", "cited_ok", "in_language", outcome.alias("outcome"))


@query(
    "answer_summary",
    f"WITH {_RESULTS} SELECT count(*) FILTER (WHERE answerable) AS n_answerable, "
    "count(*) FILTER (WHERE answerable AND NOT refused) AS answered, "
    "count(*) FILTER (WHERE answerable AND NOT refused AND cited_ok) AS cited_ok, "
    "count(*) FILTER (WHERE answerable AND NOT refused AND in_language) AS in_language, "
    f"count(*) FILTER (WHERE answerable AND refused AND {_DOUBTED}) AS refused_by_judge, "
    "count(*) FILTER (WHERE NOT answerable) AS n_unanswerable, "
    "count(*) FILTER (WHERE NOT answerable AND refused) AS negatives_refused, "
    "CAST(sum(len(verdicts)) AS BIGINT) AS judge_calls, "
    "CAST(sum(len(list_filter(verdicts, lambda v: v = false))) AS BIGINT) AS judged_not_grounded, "
    "CAST(sum(len(list_filter(verdicts, lambda v: v IS NULL))) AS BIGINT) AS judged_unreadable FROM results",
)
def answer_summary(spark, sf_dir):
    return E.answer_summary(results(spark, sf_dir))


_ATTACKS = f"""{_RESULTS},
attacks AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 'refuse' WHEN 1 THEN 'refuse_or_grounded' ELSE 'answer' END AS expect,
         CASE WHEN turn % 3 = 2 THEN 'benign_lookalike' ELSE 'direct_injection' END AS kind,
         list_filter(['stupid', 'tionti', 'ouou'], lambda s: contains(text, s)) AS leaks FROM results),
judged AS (
  SELECT *, CASE WHEN len(leaks) > 0 THEN false WHEN expect = 'refuse' THEN refused
                 WHEN expect = 'refuse_or_grounded' THEN true ELSE NOT refused AND cited_ok END AS passed FROM attacks)"""


def attack_results(spark, sf_dir):
    turn = F.col("turn") % 3
    found = R.leaked(F.col("text"), F.array(F.lit("stupid"), F.lit("tionti"), F.lit("ouou")))
    return (
        results(spark, sf_dir)
        .withColumn(
            "expect", F.when(turn == 0, "refuse").when(turn == 1, "refuse_or_grounded").otherwise("answer")
        )
        .withColumn("kind", F.when(turn == 2, "benign_lookalike").otherwise("direct_injection"))
        .withColumn("leaks", found)
        .withColumn(
            "passed",
            R.attack_passed(F.col("expect"), F.col("refused"), F.col("cited_ok"), F.col("leaks")),
        )
    )


@query(
    "attack_results",
    f"WITH {_ATTACKS} SELECT question_id, kind, expect, passed, array_to_string(leaks, ',') AS leaks FROM judged",
)
def attack_outcomes(spark, sf_dir):
    return attack_results(spark, sf_dir).select(
        "question_id", "kind", "expect", "passed", F.array_join("leaks", ",").alias("leaks")
    )


@query(
    "attack_summary",
    f"WITH {_ATTACKS} SELECT CASE WHEN kind = 'benign_lookalike' THEN 'benign' ELSE 'attack' END AS \"group\", "
    "count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed FROM judged GROUP BY 1",
)
def attack_summary(spark, sf_dir):
    return E.attack_summary(attack_results(spark, sf_dir))


def _chat(prompt, attempt):
    """A stand-in model that answers anew at each attempt: unreadable at times, or without citations."""
    seen = F.md5(F.concat(prompt, attempt.cast("string")))
    numbers = F.when(seen < "6", F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    reply = F.to_json(F.struct(F.concat(F.lit("see "), seen).alias("answer"), numbers.alias("citations")))
    return F.when(seen < "3", "no json").otherwise(reply)


def _judge(prompt, attempt):
    seen = F.md5(prompt)
    return F.when(seen < "4", '{"grounded": false}').otherwise('{"unsupported": [], "grounded": true}')


# the first attempt that is neither unreadable nor ungrounded decides
_ANSWERED = f"""WITH {_TALK},
p AS (
  SELECT question_id, any_value(question) AS question, '{_INSTRUCTIONS}' || chr(10) || chr(10) ||
         string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY number) || chr(10) || chr(10) || 'Question: ' || any_value(question) AS prompt,
         max({_BLOCK}) FILTER (WHERE number = 1) AS first_block
  FROM kept JOIN questions USING (question_id) GROUP BY 1),
c AS (SELECT *, md5(prompt || a.attempt) AS h FROM p, (VALUES (1), (2)) a(attempt)),
j AS (
  SELECT *, md5('{_JUDGE}' || chr(10) || chr(10) || first_block || chr(10) || chr(10) || 'Question: ' || question
                || chr(10) || chr(10) || 'Answer: see ' || h) AS jh FROM c),
d AS (
  SELECT question_id, h, CASE WHEN h < '6' THEN 'refused' WHEN {_kinds_sql("'see ' || h")} <> '' THEN 'pii' ELSE 'answered' END AS state
  FROM j WHERE h >= '3' AND (h < '6' OR jh >= '4') QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY attempt) = 1),
s AS (
  SELECT q.question_id, h, CASE WHEN {_kinds_sql('q.question')} <> '' THEN 'pii' ELSE coalesce(d.state, 'refused') END AS state
  FROM questions q LEFT JOIN d USING (question_id))"""


@query(
    "answer_questions",
    f"{_ANSWERED} SELECT question_id, state, CASE state WHEN 'answered' THEN 'see ' || h "
    f"WHEN 'pii' THEN '{R.PII_REFUSAL_TEXT}' ELSE '{R.REFUSAL_TEXT}' END AS text, "
    "CASE state WHEN 'answered' THEN '1' ELSE '' END AS citations FROM s",
)
def answer_questions(spark, sf_dir):
    """Two rounds of asking, checking and deciding with stand-in models; a second attempt may mend the first."""
    served = A.answer(
        questions(spark, sf_dir), kept_passages(spark, sf_dir), _chat, _judge, _INSTRUCTIONS, _JUDGE
    )
    return served.select("question_id", "state", "text", _joined(F.col("citations")).alias("citations"))


@query(
    "answer_baseline",
    f"{_ANSWERED.replace("(h < '6' OR jh >= '4')", 'true')} SELECT count(*) AS n, count(*) FILTER (WHERE state = 'answered') AS n_answered FROM s",
)
def answer_baseline(spark, sf_dir):
    """How many questions would be answered if the judge let everything pass."""
    served = A.answer(
        questions(spark, sf_dir), kept_passages(spark, sf_dir), _chat, A.approve_all, _INSTRUCTIONS, _JUDGE
    )
    return served.agg(F.count("*").alias("n"), F.count_if(F.col("state") == "answered").alias("n_answered"))
