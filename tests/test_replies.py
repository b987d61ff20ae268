"""Replies read by plain types first, and joins that stay off the driver."""

import pytest
from pyspark.sql import functions as F

from tablecheck.functions import replies as rp
from tablecheck.operators import evidence as ev, scoring as so

REPLIES = [
    ('{"score": 3, "feedback": "x", "evidence": ["a", null, 1.50]}', (True, 3, "x", ["a", None, "1.5"])),
    ('{"score": "0_3", "evidence": "[\\"a\\", 1]"}', (True, 3, "", ["a", "1"])),
    ('{"score": 3.7, "evidence": {"a": 1}}', (True, 3, "", ['{"a":1}'])),
    ('{"score": "3.7"}', (False, None, None, None)),
    ('{"score": null, "evidence": "single"}', (True, None, "", ["single"])),
    ('{"score": 5, "evidence": []}', (False, None, None, None)),
    ('{"score": 2, "evidence": ["cut', (False, None, None, None)),
    ('{"score": {"a": 1}, "evidence": ["cut', (False, None, None, None)),
    ("x\n```json\n{\"score\": true}\n```", (True, 1, "", [])),
    ("not json", (False, None, None, None)),
    (None, (True, None, "", [])),
]


def test_reply_forms(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    assert [tuple(r)[2:] for r in rp.parse_replies(df).orderBy("i").collect()] == [want for _, want in REPLIES]
    assert [r.i for r in rp.sound_replies(df).orderBy("i").collect()] == [i for i, (_, want) in enumerate(REPLIES) if want[0]]


def test_sound_replies_evaluate_a_reply_once(spark):
    plan = rp.sound_replies(spark.range(1).select(F.col("id").cast("string").alias("reply")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and plan.count("Generate") == 1


@pytest.mark.parametrize("side", ["verify", "check_expected"])
def test_small_looking_sides_are_not_broadcast(spark, side):
    keys = spark.range(4).select(F.col("id").cast("string").alias("case_id"), F.lit("d").alias("dimension"))
    if side == "verify":
        df = ev.verify(keys.withColumn("evidence", F.array(F.lit("VERIFIED"))), keys.withColumn("reply", F.lit("[]")), ["case_id", "dimension"])
    else:
        expected = keys.select("*", F.lit(1).alias("lo"), F.lit(2).alias("hi"), F.lit(False).alias("is_na"))
        df = so.check_expected(keys.withColumn("score", F.lit(1)), expected)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 4


def test_tone_of_words(spark):
    rows = [("GOOD but not goodness", "good"), ("Hard-coded and wrong, clear", "bad"), ("good bad poor", "neutral"), ("", "neutral"), (None, "neutral")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", rp.sentiment_words(F.col("t")).alias("tone"))
    # "bad" is no listed word, "poor" is
    assert {r.t: r.tone for r in df.collect()} == dict(rows)


def test_claims_are_looked_at_once(spark):
    lists = [["+VERIFIED: a", None, "x", "-verified b", "INFERRED, verified later", "VERIFIED"], ["x", None], [], None]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(lists)], "i int, evidence array<string>").select("i", ev.claim_numbers(F.col("evidence")).alias("c"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 2  # one look for each of the two words
    got = {r.i: r.c and [tuple(x) for x in r.c] for r in df.collect()}
    numbers = [1, None, None, 2, None, 3]
    assert got == {0: [(p, t, n) for p, (t, n) in enumerate(zip(lists[0], numbers))], 1: [(0, "x", None), (1, None, None)], 2: [], 3: None}


def test_usual_replies_are_read_outside_nested_functions(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    whole = df.select("i", rp.parse_reply(F.col("reply")).alias("p")).select("i", "p.*").orderBy("i").collect()
    steps = rp.parse_replies(df).drop("reply").orderBy("i")
    assert [tuple(r) for r in steps.collect()] == [tuple(r) for r in whole]
    lines = steps._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Project" in x and "from_json" in x and "lambda" not in x for x in lines)
