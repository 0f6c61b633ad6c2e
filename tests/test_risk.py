"""Scoring of findings that come as rows."""

import random
from decimal import Decimal

import pytest

from leaksieve import score_findings
from leaksieve import fixed_values as fv
from leaksieve.operators import breakdown_of, legacy_score

GOLDEN = [
    # findings, (raw, bonus, score, level), browser (score, level)
    ([("aadhaar", 3), ("aws_access", 1), ("email", 5)], ("84.60", 12, 97, "CRITICAL"), (97, "CRITICAL")),
    ([("phone_in", 1)], ("10.50", 0, 10, "LOW"), (11, "LOW")),
    ([("jwt", 2)], ("32.50", 0, 32, "MEDIUM"), (33, "MEDIUM")),
    ([("pan", 1), ("jwt", 1), ("db_conn", 1)], ("72.50", 12, 84, "HIGH"), (85, "CRITICAL")),
    ([("passport", 101)], ("52.50", 0, 52, "MEDIUM"), (53, "MEDIUM")),
    ([("email", 1), ("password", 1)], ("15.00", 5, 20, "LOW"), (20, "LOW")),
    ([("unknown_key", 1)], ("7.00", 0, 7, "LOW"), (7, "LOW")),
    ([("email", 0)], ("0.00", 12, 12, "LOW"), (0, "LOW")),
    ([("email", 1), ("email", 1), ("email", 1)], ("21.00", 12, 33, "MEDIUM"), (33, "MEDIUM")),
    ([(r[0], 200) for r in fv.RULE_ROWS], ("612.50", 12, 100, "CRITICAL"), (100, "CRITICAL")),
]
CONFIDENCE = {r[0]: r[4] for r in fv.RULE_ROWS}


def rows():
    return [(i, seq, k, n, CONFIDENCE.get(k)) for i, (fs, *_) in enumerate(GOLDEN) for seq, (k, n) in enumerate(fs)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "i int, seq int, key string, count int, confidence string")


def test_golden_scores(table):
    got = {r.i: r for r in score_findings(table, ["i"]).collect()}
    for i, (_, want, _) in enumerate(GOLDEN):
        r = got[i]
        assert (r.raw_score, r.cooccurrence_bonus, r.score, r.risk_level) == (Decimal(want[0]), *want[1:]), i
    assert {r.score for r in legacy_score(score_findings(table, ["i"])).where("i = 0").collect()} == {97.0}


def test_golden_scores_browser(table):
    got = {r.i: (r.score, r.risk_level) for r in score_findings(table, ["i"], profile="browser").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(GOLDEN)}


def test_nulls_in_findings(spark):
    df = spark.createDataFrame([(1, None, 3, "HIGH"), (1, "email", None, "LOW"), (1, "jwt", 1, None)],
                               "i int, key string, count int, confidence string")
    r = score_findings(df, ["i"]).first()
    assert (r.raw_score, r.active_types, r.score, r.total_findings) == (Decimal("30.50"), 2, 36, 4)


def test_last_entry_of_a_repeated_key_stands(spark):
    df = spark.createDataFrame(
        [(1, 1, "email", 7, "HIGH"), (1, 3, "email", 2, "LOW"), (1, 2, "email", 90, "MEDIUM"), (1, 4, "email", 0, "HIGH"),
         (1, 5, "jwt", 1, None)], "i int, seq int, key string, count int, confidence string")
    got = {r.key: (r["count"], r.confidence, r.severity_weight, float(r.contribution)) for r in breakdown_of(df, ["i"], last_by="seq").collect()}
    assert got == {"email": (2, "LOW", 10, 5.2), "jwt": (1, None, 25, 17.5)}
    unique = df.where("seq in (3, 5)")
    plan = breakdown_of(unique, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and breakdown_of(unique, ["i"]).count() == 2


def test_scores_equal_brute_force(spark):
    rng = random.Random(3)
    keys = list(fv.WEIGHTS) + ["other"]
    data = [(rng.randrange(300), rng.choice(keys), rng.choice([0, 1, 2, 5, 6, 20, 21, 100, 101, 5000]),
             rng.choice(["HIGH", "MEDIUM", "LOW", "?", None])) for _ in range(2000)]
    # one group holds a third of all rows
    data += [(7, rng.choice(keys), 1, "LOW") for _ in range(1000)]
    df = spark.createDataFrame(data, "i int, key string, count int, confidence string")
    want = {}
    for i, key, n, confidence in data:
        raw, types, total = want.get(i, (Decimal(0), 0, 0))
        factor = Decimal(fv.CONFIDENCE_FACTORS.get(confidence, "0.7"))
        tier = next((Decimal(w) for low, high, w in fv.VOLUME_TIERS if low <= n <= high), Decimal("2.5"))
        want[i] = (raw + fv.WEIGHTS.get(key, 10) * factor * tier, types + (n > 0), total + n)
    scored = score_findings(df, ["i"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    got = {r.i: (r.raw_score, r.active_types, r.total_findings) for r in scored.collect()}
    assert got == want


def test_custom_weights(spark):
    from leaksieve import Rule, with_rules

    rules = with_rules(Rule("ticket", "Ticket", "PII", "low", "HIGH", "T", weight=40))
    df = spark.createDataFrame([(1, "ticket", 1, "HIGH")], "i int, key string, count int, confidence string")
    assert score_findings(df, ["i"], rules=rules).first().score == 40
    assert score_findings(df, ["i"]).first().score == 10
