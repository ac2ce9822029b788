import json

import pytest
from pyspark.sql import functions as F

from quirework.functions import pii as G, replies as R
from quirework.operators import answers as A

X = F.col("x")


def check_digit(first):
    return (11 - sum(int(d) * (13 - i) for i, d in enumerate(first)) % 11) % 10


NUMBERS = [f + str(check_digit(f)) for f in ("470020631857", "820514009966", "159900000042")]
VALID = NUMBERS[0]
WRONG = [n[:12] + str((int(n[12]) + 3) % 10) for n in NUMBERS]


def test_pii_found(evaluate):
    a, b, c = NUMBERS
    cases = {
        f"Card {a} was lost at the pier.": ["thai_national_id"],
        f"{WRONG[1]}, no: {b}": ["thai_national_id"],
        f"ref {c[0]} {c[1:5]} {c[5:10]} {c[10:12]} {c[12]} please": ["thai_national_id"],
        "ring 02-555-0142 after six": ["thai_phone"],
        "เบอร์ 0955550177": ["thai_phone"],
        "write to lost+found@harbour.example": ["email"],
        f"me@tide.example / 0 2555 0142 / {a}": ["email", "thai_national_id", "thai_phone"],
    }
    assert evaluate(G.find_pii(X), list(cases)) == list(cases.values())


def test_pii_not_found(evaluate):
    texts = [
        "12.5 mm of rain in 24 hours, 3 gauges",
        f"parcel {WRONG[0]}",
        f"serial 9{VALID}",
        f"{VALID}77",
        "tide table 2024, sheets 11-19",
        "at@home, or @pier.example",
        "call 1555-0142",
        None,
    ]
    found = evaluate(G.find_pii(X), texts)
    assert found[:-1] == [[]] * 7 and not found[-1]
    assert evaluate(G.find_pii(X, ("email",)), [VALID]) == [[]]


def test_check_digits_of_many_numbers(evaluate):
    firsts = [f"{(i * 98765432109 + 7) % 10**12:012d}" for i in range(40)]
    right = [f + str(check_digit(f)) for f in firsts]
    wrong = [f + str((check_digit(f) + 1 + i % 9) % 10) for i, f in enumerate(firsts)]
    kinds = G.find_pii(X, ("thai_national_id",))
    assert evaluate(kinds, right) == [["thai_national_id"]] * 40 and evaluate(kinds, wrong) == [[]] * 40


def test_parse_reply(evaluate):
    def reply(numbers, answer="a"):
        return json.dumps({"answer": answer, "citations": numbers})

    raws = [reply([2, 1, 2]), reply([]), reply([1, 3]), reply([0]), "not json", '{"answer": "a"}', '{"citations": [1]}']
    got = evaluate(R.parse_reply(X, F.lit(2)), raws)
    assert [(g["valid"], g["answer"], g["citations"]) for g in got] == [
        (True, "a", [2, 1]),
        (True, R.REFUSAL_TEXT, []),
        *[(False, None, None)] * 5,
    ]
    good = reply([1])
    wrong = [good + " x", f"```json\n{good}\n```", good.replace('"', "'"), good + good, good[:-1], "", None, reply(["1"]), reply([True]), reply([1.0]), reply([1], 5), reply([1], None), reply(1)]
    assert [g["valid"] for g in evaluate(R.parse_reply(X, F.lit(2)), wrong)] == [False] * len(wrong)


def test_identity_numbers_in_every_script(evaluate):
    scripts = ["٠١٢٣٤٥٦٧٨٩", "０１２３４５６７８９", "०१२३४५६७८९", "𝟎𝟏𝟐𝟑𝟒𝟓𝟔𝟕𝟖𝟗"]
    other = [VALID.translate(str.maketrans("0123456789", s)) for s in scripts]
    wrong = [VALID[:-1] + str((int(VALID[-1]) + 1) % 10)]
    wrong += [wrong[0].translate(str.maketrans("0123456789", s)) for s in scripts]
    assert evaluate(G.find_pii(X, ("thai_national_id",)), other) == [["thai_national_id"]] * 4
    assert evaluate(G.find_pii(X, ("thai_national_id",)), wrong) == [[]] * 5


def test_parse_verdict(evaluate):
    raws = ['{"grounded": true}', ' {"grounded": false}\n', '{"grounded": "maybe"}', '{"grounded": 1}', '{"unsupported": []}', "fine", "[]", None]
    raws += ['{"grounded": true} trailing', '{"grounded": false}\n```', "{'grounded': true}", '{"grounded": true}{"grounded": true}', '[true]', ""]
    assert evaluate(R.parse_verdict(X), raws) == [True, False] + [None] * 12


def test_labels(evaluate):
    assert evaluate(R.verdict_string(X), [[True, False, None], []], "array<boolean>") == ["TF?", "-"]
    block = R.passage_block(F.lit(3), X, F.lit("text"))
    assert evaluate(block, ["crop", None, ""]) == ["[3] (crop) text", "[3] text", "[3] text"]
    rule = R.attack_passed(X, F.lit(True), F.lit(False), F.array().cast("array<string>"))
    assert evaluate(rule, ["refuse", "refuse_or_grounded", "answer"]) == [True, True, False]
    leaked = R.attack_passed(X, F.lit(True), F.lit(True), F.array(F.lit("canary")))
    assert evaluate(leaked, ["refuse"]) == [False]
    with pytest.raises(Exception, match="unknown expect"):
        evaluate(rule, ["other"])


def states(spark, *attempts, question="q"):
    rows = [(1, i + 1, reply, judge, 2) for i, (reply, judge) in enumerate(attempts)]
    evaluated = A.evaluate_attempts(
        spark.createDataFrame(rows, "question_id int, attempt int, reply string, judge_reply string, n_passages int")
    )
    questions = spark.createDataFrame([(1, question)], "question_id int, question string")
    row = A.resolve_attempts(questions, evaluated).first()
    return row["state"], row["text"], row["citations"]


GOOD = json.dumps({"answer": "yes", "citations": [1]})
EMPTY = json.dumps({"answer": "ignored", "citations": []})
LEAK = json.dumps({"answer": "write a.b@example.org", "citations": [1]})
BAD = "```json"
YES, NO, MAYBE = '{"grounded": true}', '{"grounded": false}', '{"grounded": "maybe"}'
REFUSED = ("refused", R.REFUSAL_TEXT, [])


def test_attempts(spark):
    assert states(spark, (GOOD, YES), (BAD, None)) == ("answered", "yes", [1])
    assert states(spark, (BAD, None), (GOOD, YES)) == ("answered", "yes", [1])
    assert states(spark, (GOOD, NO), (GOOD, YES)) == ("answered", "yes", [1])
    assert states(spark, (GOOD, NO), (BAD, None)) == REFUSED
    assert states(spark, (BAD, None), (BAD, None), (GOOD, YES)) == REFUSED
    assert states(spark, (EMPTY, None), (GOOD, YES)) == REFUSED
    assert states(spark, (GOOD, MAYBE), (GOOD, YES)) == ("undecided", R.REFUSAL_TEXT, [])
    assert states(spark, (LEAK, YES), (GOOD, YES)) == ("pii", R.PII_REFUSAL_TEXT, [])
    assert states(spark, (GOOD, YES), question="call 02-555-0142")[0] == "pii"


def test_answer_asks_again_only_where_needed(spark):
    questions = spark.createDataFrame(
        [(1, "fine"), (2, "stubborn"), (3, "nothing kept"), (4, "mail a.b@example.org")],
        "question_id int, question string",
    )
    kept = spark.createDataFrame(
        [(q, n, f"c{n}", None if n == 1 else "crop", f"text {n}", 0.9) for q in (1, 2, 4) for n in (2, 1)],
        "question_id int, number int, chunk_id string, section string, content string, score double",
    )
    prompts = A.build_prompts(kept, questions, "Rules").filter("question_id = 1").first()
    assert prompts["prompt"] == "Rules\n\n[1] text 1\n\n[2] (crop) text 2\n\nQuestion: fine"

    chat = lambda prompt, attempt: F.when(F.contains(prompt, F.lit("stubborn")), BAD).otherwise(GOOD)
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def judge(prompt, attempt):
        seen.add(len(prompt))
        assert all("text 2" not in p for p in prompt)  # only cited excerpts are shown
        return prompt.map(lambda _: YES)

    rows = A.answer(questions, kept, chat, judge, "Rules", "Judge").orderBy("question_id").collect()
    assert [r["state"] for r in rows] == ["answered", "refused", "refused", "pii"]
    assert seen.value == 1
