"""Findings, their order and samples, whole reports, and the shape of the plans."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import plain
from leaksieve import (
    RULES, Rule, assess, exposure_by, findings_table, flat_report, report, scan, scan_log, text_table, top_risky,
    with_risk, with_rules,
)
from leaksieve import fixed_values as fv
from leaksieve.operators import breakdown_table, documents_by_level, numbered_recommendations, sample_table, with_flags
from leaksieve.sources import report_violations, spread
from test_rules import GOLDEN, texts

DATA = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "i int, text string")


@pytest.mark.parametrize("profile", ["backend", "browser"])
def test_findings_equal_brute_force(spark, profile):
    browser = profile == "browser"
    rng = random.Random(11)
    pool = texts(1500, 12)
    rows = [" ".join(rng.choices(pool, k=rng.randint(0, 6))) for _ in range(1500)]
    if browser:
        rows = [re.sub("[\x1c\u00a0\u2028\ufeff\U0001f600]", " ", t) for t in rows]
    got = scan(frame(spark, rows), profile=profile).orderBy("i").collect()
    for text, row in zip(rows, got):
        want = plain.findings(text, browser)
        assert [(f.key, f["count"], f.samples) for f in row.findings] == want, text
        assert row.total_characters == len(text)


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "i int, text string")
    rows = assess(df).orderBy("i").collect()
    assert [(r.total_characters, r.findings, r.score, r.recommendations) for r in rows] == [(0, [], 12, [])] * 2
    assert [r.score for r in assess(df, profile="browser").collect()] == [0, 0]


def test_samples_are_the_first_three_distinct(spark):
    text = " ".join(["ann@x.io", "bob@x.io", "ann@x.io", "cyd@x.io", "dan@x.io"])
    finding = scan(frame(spark, [text])).first().findings[0]
    assert finding["count"] == 5 and finding.samples == ["an****io", "bo****io", "cy****io"]
    # distinct before redaction: two samples may look alike
    assert scan(frame(spark, ["abcd@x.io abzd@x.io"])).first().findings[0].samples == ["ab*****io"] * 2


def test_worked_example(spark):
    ids = ["200000000009", "200000000013", "200000000021"]
    mails = [f"user{i}@example.com" for i in range(5)]
    text = " ; ".join(ids + ["AKIA" + "Z" * 16] + mails)
    for profile in ("backend", "browser"):
        row = assess(frame(spark, [text]), profile=profile).first()
        assert (row.raw_score, row.cooccurrence_bonus, row.score, row.risk_level) == (
            Decimal("84.60"), 12, 97, "CRITICAL")
        assert row.total_findings == 9 and set(row.breakdown) == {"aadhaar", "aws_access", "email"}
        assert row.breakdown["aadhaar"].contribution == Decimal("45.50")
    keys = [f.key for f in assess(frame(spark, [text])).first().findings]
    assert keys == ["email", "aadhaar", "aws_access"]
    keys = [f.key for f in assess(frame(spark, [text]), profile="browser").first().findings]
    assert keys == ["aadhaar", "aws_access", "email"]


def test_recommendations(spark):
    text = "a@b.cc c@d.ee A1234567 AKIA" + "Z" * 16 + " ABCDE1234F"
    row = assess(frame(spark, [text])).first()
    heavy = [f.key for f in row.findings if fv.WEIGHTS[f.key] == 30]
    assert heavy == ["pan", "passport", "aws_access"]
    assert row.recommendations == [fv.ADVICE_BACKEND[k] for k in heavy + ["email"]] + list(fv.ADVICE_ALWAYS_BACKEND)
    row = assess(frame(spark, [text]), profile="browser").first()
    assert row.recommendations == [fv.ADVICE_BROWSER[k] for k in ("pan", "aws_access", "passport", "email")] + list(
        fv.ADVICE_ALWAYS_BROWSER)
    numbered = numbered_recommendations(assess(frame(spark, [text])), ["i"]).orderBy("number").collect()
    assert [r.number for r in numbered] == [1, 2, 3, 4, 5, 6]


def test_report_record(spark):
    df = spark.createDataFrame([("a.txt", "mail é@x a@b.cc"), ("b.txt", "nothing")], "filename string, text string")
    rows = {r.filename: r for r in report(df).collect()}
    assert report(df).columns == [
        "status", "filename", "size_bytes", "total_characters", "score", "risk_level", "total_findings",
        "findings", "breakdown", "cooccurrence_bonus", "raw_score", "recommendations"]
    assert (rows["a.txt"].size_bytes, rows["a.txt"].total_characters) == (16, 15)
    assert rows["a.txt"].findings[0].asDict() == {
        "category": "PII", "label": "Email Address", "count": 1, "severity": "medium",
        "confidence": "MEDIUM", "samples": ["a*****"]}
    assert "key" in report(df, profile="browser").first().findings[0].asDict()
    assert rows["b.txt"].score == 12 and rows["b.txt"].breakdown == {}
    assert scan_log(report(df)).columns == [
        "filename", "size_bytes", "chars", "findings", "score", "risk_level", "raw_score", "cooccurrence_bonus"]
    assert report_violations(report(df)).count() == 0


def test_breakdown_order(spark):
    text = "pwd=12345678 a@b.cc A1234567"  # 8.0, 7.0, 21.0
    scored = with_risk(scan(frame(spark, [text])))
    rows = breakdown_table(scored, ["i"]).orderBy("rank").collect()
    assert [(r.key, r.label, float(r.contribution)) for r in rows] == [
        ("passport", "PASSPORT", 21.0), ("password", "PASSWORD", 8.0), ("email", "EMAIL", 7.0)]


def test_no_raw_match_leaves(spark):
    """No output column of any view holds an unredacted match."""
    rows = [g[0] for g in GOLDEN] + ["x " + " ".join(g[0] for g in GOLDEN)]
    secrets = {m for t in rows for k in plain.COMPILED for m in plain.matches(k, t) if len(m) > 6}
    assert len(secrets) > 10
    df = frame(spark, rows).withColumn("filename", F.lit("f.txt"))
    outputs = [assess(df.drop("filename")), report(df), report(df, profile="browser"),
               findings_table(scan(df), ["i"]), sample_table(scan(df), ["i"])]
    for out in outputs:
        shown = "\n".join(r[0] for r in out.select(F.to_json(F.struct("*"))).collect())
        assert not [s for s in secrets if s in shown]


def test_rollups_equal_brute_force(spark):
    rng = random.Random(5)
    pool = texts(400, 21) + ["clean"] * 100
    rows = [(i, rng.choice("aab"), " ".join(rng.choices(pool, k=3))) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, source string, text string")
    scanned = scan(df)
    category = {r[0]: r[2] for r in fv.RULE_ROWS}
    want, per_key = {}, {}
    for _, source, text in rows:
        seen = set()
        for key, count, _ in plain.findings(text):
            group = (source, category[key])
            docs, n = want.get(group, (0, 0))
            want[group] = (docs + (group not in seen), n + count)
            seen.add(group)
            docs, n = per_key.get(key, (0, 0))
            per_key[key] = (docs + 1, n + count)
    got = {(r.source, r.category): (r.documents, r.matches) for r in exposure_by(scanned, "source", "category").collect()}
    assert got == want
    assert {r.key: (r.documents, r.matches) for r in exposure_by(scanned, "key").collect()} == per_key
    hit = exposure_by(scanned, "source").collect()
    assert sum(r.documents for r in hit) == sum(bool(plain.findings(t)) for *_, t in rows)
    assert with_flags(scanned).where("sensitive").count() == sum(r.documents for r in hit)
    scored = with_risk(scanned)
    assert sum(r.documents for r in documents_by_level(scored, "source").collect()) == len(rows)
    top = top_risky(scored, 7, ["i"]).collect()
    every = sorted(((-r.score, r.i) for r in scored.collect()))[:7]
    assert [(-r.score, r.i) for r in top] == every
    with pytest.raises(ValueError):
        exposure_by(scanned, "nowhere")


def plan_of(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def documents(spark, partitions=None):
    return text_table(spark, f"{DATA}/documents.parquet", keep=["doc_id"], partitions=partitions)


def test_each_pattern_runs_once(spark):
    done = assess(documents(spark))
    uses = [done.where("score > 30"), done.where(F.size("findings") > 0).where("risk_level = 'HIGH'"),
            findings_table(done, ["doc_id"]).where("key = 'email'"), flat_report(done, ["doc_id"]).where("types > 1"),
            exposure_by(scan(documents(spark)), "key"), breakdown_table(done, ["doc_id"])]
    for df in uses:
        plan = plan_of(df, "optimizedPlan")
        assert plan.count(r"@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}") == 1
        assert plan.count("(?:AKIA|ASIA") == 1


def test_no_shuffle_and_no_python(spark):
    plan = plan_of(assess(documents(spark)))
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    by_key = plan_of(exposure_by(scan(documents(spark)), "key"))
    assert by_key.count("Exchange") == 1 and "partial_sum" in by_key
    top = plan_of(top_risky(with_risk(scan(documents(spark))), 5, ["doc_id"]))
    assert "TakeOrderedAndProject" in top and "Exchange" not in top


def test_only_needed_columns_are_read(spark):
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan_of(assess(documents(spark))))
    by_key = exposure_by(scan(documents(spark)), "key")
    assert re.search(r"ReadSchema: struct<text:string>", plan_of(by_key))


def test_filters_on_kept_columns_reach_the_scan(spark):
    found = scan(documents(spark)).where("doc_id < 10")
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in plan_of(found)


def test_spread(spark):
    small = documents(spark)
    cores = spark.sparkContext.defaultParallelism
    assert spread(small, "auto").rdd.getNumPartitions() == 2 * cores
    wide = spark.range(0, 1000, 1, 4 * cores)
    assert spread(wide, "auto").rdd.getNumPartitions() == 4 * cores  # enough splits: left alone
    assert spread(wide, 3).rdd.getNumPartitions() == 3
    assert spread(small).rdd.getNumPartitions() == small.rdd.getNumPartitions()
    assert "Exchange" not in plan_of(scan(text_table(spark, f"{DATA}/documents.parquet")))
    assert spread(small, "auto").count() == small.count()


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        scan(documents(spark), rules=[])
    with pytest.raises(ValueError):
        scan(documents(spark), rules=[RULES[0], RULES[0]])
    with pytest.raises(ValueError):
        scan(documents(spark), profile="desktop")


def test_scores_need_neither_samples_nor_breakdown(spark):
    texts = spark.createDataFrame([(1, "mail a@b.cc and c@d.ee"), (2, ""), (3, None)], "id int, text string")
    lean = with_risk(scan(texts, samples=False))
    assert "samples" not in lean.schema["findings"].dataType.elementType.names
    scores = lean.select("id", "score", "risk_level", "total_findings", "raw_score")
    assert "map_from_entries" not in scores._jdf.queryExecution().optimizedPlan().toString()
    full = with_risk(scan(texts)).select(*scores.columns)
    assert sorted(scores.collect()) == sorted(full.collect())


def test_advice_of_own_rules(spark):
    texts = spark.createDataFrame([("TCK-1234",)], "text string")
    rule = Rule("ticket", "Ticket", "PII", "low", "MEDIUM", r"\bTCK-\d{4}\b", advice="Close it.", browser_advice="Shut it.")
    for profile, want in (("backend", "Close it."), ("browser", "Shut it.")):
        got = assess(texts, rules=with_rules(rule), profile=profile).first().recommendations
        assert got[0] == want and len(got) == 3
    silent = Rule("ticket", "Ticket", "PII", "low", "MEDIUM", r"\bTCK-\d{4}\b")
    assert len(assess(texts, rules=with_rules(silent)).first().recommendations) == 2
