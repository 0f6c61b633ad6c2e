"""Unread rows, clashing names, masked texts, SQL functions, folders, streams with state and wider roll-ups."""

import itertools
import os
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import plain
from leaksieve import RULES, Rule, assess, exposure_by, extract_text, mask, register_functions, report, scan, top_risky, with_recommendations, with_risk
from leaksieve import fixed_values as fv
from leaksieve import functions as fn
from leaksieve.operators import (
    breakdown_of, breakdown_table, distinct_values, documents_by_level, exposure_cube, findings_table, merge_values,
    sample_table, top_risky_by, value_hashes, with_flags,
)
from leaksieve.plans import flat_report
from leaksieve.plans.corpus import texts as corpus_texts
from leaksieve.sources import current, list_files, load_files, report_violations, save_files, unseen, update, write_checked
from leaksieve.streaming import latest_groups, once, read_batches, read_stream, report_stream, start_batches
from test_rules import GOLDEN, texts

SF = "/root/testdata/sf0.001"


# rows that were not read


def uploads(spark):
    rows = [
        ("good.txt", b"a@b.cc"), ("clean.csv", b"nothing here"), ("bad.exe", b"pwd=12345678 a@b.cc"),
        ("empty.txt", b""), ("scan.pdf", b"a@b.cc"), ("big.txt", b"a@b.cc " * 100),
    ]
    files = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in rows], "filename string, size_bytes long, content binary")
    return extract_text(files, max_bytes=500)


def test_unread_rows_have_no_results(spark):
    rows = {r.filename: r for r in assess(uploads(spark)).collect()}
    assert {n: r.score for n, r in rows.items()} == {
        "good.txt": 7, "clean.csv": 12, "bad.exe": None, "empty.txt": None, "scan.pdf": None, "big.txt": None}
    for name in ("bad.exe", "empty.txt", "scan.pdf", "big.txt"):
        made = ("total_characters", "findings", "total_findings", "breakdown", "raw_score", "cooccurrence_bonus", "risk_level", "recommendations")
        assert [rows[name][c] for c in made] == [None] * len(made)
    scored = with_risk(scan(uploads(spark), samples=False))
    assert {r.risk_level: r.documents for r in documents_by_level(scored).collect()} == {"LOW": 2, "UNREAD": 4}
    assert [r.filename for r in top_risky(scored, 10, ["filename"]).collect()] == ["clean.csv", "good.txt"]
    assert [(r.key, r.documents) for r in exposure_by(scored, "key").collect()] == [("email", 1)]
    assert {r.filename: r.sensitive for r in with_flags(scored).collect()}["bad.exe"] is None
    assert findings_table(scored, ["filename"]).count() == 1
    flat = {r.filename: r for r in flat_report(assess(uploads(spark)), ["filename"]).collect()}
    assert flat["bad.exe"].types is None and flat["bad.exe"].n_recommendations is None and flat["clean.csv"].types == 0
    masked = {r.filename: r for r in mask(uploads(spark)).collect()}
    assert masked["bad.exe"].masked_text is None and masked["bad.exe"].masked is None and masked["good.txt"].masked_text == "a*****"


def test_a_column_named_status_alone_is_an_ordinary_column(spark):
    df = spark.createDataFrame([("closed", "a@b.cc")], "status string, text string")
    assert [(r.status, r.score) for r in assess(df).collect()] == [("closed", 7)]


# names

INNER = ["_text", "_lower", "_hint_0", "_status", "_pos", "_f", "_b", "_n", "_latest", "text_", "a.b", "with space", "lower", "x`y"]


def test_any_other_names_may_be_kept(spark):
    quoted = ", ".join("`" + name.replace("`", "``") + "` string" for name in INNER)
    df = spark.createDataFrame([(*INNER, "a@b.cc pwd=12345678")], f"{quoted}, text string")
    done = assess(df)
    views = [
        done, findings_table(done, INNER), sample_table(done, INNER), breakdown_table(done, INNER), exposure_by(done, *INNER),
        documents_by_level(done, *INNER), top_risky(done, 1, INNER), mask(df), top_risky_by(done, 1, INNER[:2], INNER),
        report(df.withColumn("filename", F.lit("f")), keep=INNER), exposure_cube(done, INNER[:2]).where("grouping = 0"),
    ]
    for view in views:
        rows = view.collect()
        assert rows and all(r[name] == name for r in rows for name in INNER if name in view.columns), view.columns
    assert done.first().score == 20


@pytest.mark.parametrize("name", ["findings", "total_characters", "Findings"])
def test_names_that_scan_makes_raise(spark, name):
    df = spark.createDataFrame([("kept", "a@b.cc")], f"{name} string, text string")
    with pytest.raises(ValueError, match=name):
        scan(df)


@pytest.mark.parametrize("name", ["breakdown", "total_findings", "raw_score", "cooccurrence_bonus", "score", "risk_level", "recommendations", "Score"])
def test_names_that_scoring_makes_raise(spark, name):
    scanned = scan(spark.createDataFrame([("kept", "a@b.cc")], f"{name} string, text string"))
    with pytest.raises(ValueError, match=name):
        with_recommendations(with_risk(scanned))


def test_names_of_views_raise(spark):
    df = spark.createDataFrame([("kept", "k", "a@b.cc")], "key string, documents string, text string")
    done = assess(df)
    for call in (
        lambda: findings_table(done, ["key"]), lambda: exposure_by(done, "documents"), lambda: exposure_cube(done, ["documents"]),
        lambda: breakdown_of(df, ["key"]), lambda: mask(df.withColumn("masked", F.lit(1))), lambda: report(df, keep=["score"]),
    ):
        with pytest.raises(ValueError):
            call()


# masked texts


def plain_masked(text, rules=None):
    stars, places = set(), []
    for i, (key, pattern) in enumerate(plain.COMPILED.items()):
        accepted = plain.matches(key, text)
        for m in pattern.finditer(text):
            if m.group(0) in accepted:
                a, b = m.span()
                places.append((a, i, key, b))
                stars |= set(range(a + 1, b) if b - a <= 6 else range(a + 2, b - 2))
    return "".join("*" if i in stars else c for i, c in enumerate(text)), [(k, a, b) for a, _, k, b in sorted(places)]


def test_masked_texts_equal_brute_force(spark):
    rng = random.Random(8)
    pool = texts(800, 31) + [g[0] for g in GOLDEN] + ["😀", "日本", "é", "\n", "clean words"]
    rows = ["".join(rng.choices(pool, k=rng.randint(0, 8))) for _ in range(600)] + [" ".join(rng.choices(pool, k=30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string").repartition(4)
    got = {r.i: r for r in mask(df).collect()}
    for i, text in enumerate(rows):
        want, places = plain_masked(text)
        assert (got[i].masked_text, [tuple(p) for p in got[i].masked]) == (want, places), text
    assert sum(bool(r.masked) for r in got.values()) > 200


def test_masked_texts_hold_no_match(spark):
    # nothing of a match longer than what its redaction shows is left
    rows = [" ".join(g[0] for g in GOLDEN), "pwd=AKIA" + "Z" * 16 + ";a@b.cc"]
    for r in mask(spark.createDataFrame(list(enumerate(rows)), "i int, text string")).collect():
        text = rows[r.i]
        assert len(r.masked_text) == len(text) and len(r.masked) > 2
        for place in r.masked:
            shown = r.masked_text[place.start : place.end]
            assert shown != text[place.start : place.end] and shown.count("*") >= len(shown) - 4


def test_masking_own_rules_empty_and_browser(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "TCK-1234 a@b.cc POSTGRES://u:p@host")], "i int, text string")
    ticket = Rule("ticket", "Ticket", "PII", "low", "LOW", r"\bTCK-\d{4}\b")
    rows = {r.i: r for r in mask(df, rules=[ticket]).collect()}
    assert (rows[1].masked_text, rows[1].masked, rows[2].masked_text) == ("", [], "")
    assert rows[3].masked_text == "TC****34 a@b.cc POSTGRES://u:p@host"
    assert [p.key for p in mask(df, profile="browser").where("i = 3").first().masked] == ["email", "db_conn"]
    assert mask(df.limit(0)).count() == 0


def test_masking_takes_time_in_line_with_matches(spark):
    df = spark.createDataFrame([(1, "ann@example.com " * 150_000)], "i int, text string")
    start = time.monotonic()
    row = mask(df).select(F.size("masked").alias("n"), F.length("masked_text").alias("chars")).first()
    assert (row.n, row.chars) == (150_000, 2_400_000) and time.monotonic() - start < 60


def test_masking_is_no_shuffle_and_runs_on_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, f"user{i}@example.com") for i in range(20)], "i int, text string")
    assert "Exchange" not in mask(df)._jdf.queryExecution().executedPlan().toString()
    df.write.parquet(str(tmp_path / "in"))
    arriving = read_stream(spark, str(tmp_path / "in"), df.schema)
    start_batches(mask(arriving), str(tmp_path / "out"), str(tmp_path / "state"), until_done=True).awaitTermination()
    got = read_batches(spark, str(tmp_path / "out"), mask(df).schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, mask(df).collect()))


# SQL functions


@pytest.mark.parametrize("profile", ["backend", "browser"])
def test_sql_functions_are_the_columns(spark, profile):
    p = f"t_{profile}_"
    names = register_functions(spark, profile, p)
    assert len(names) == 15 and all(n.startswith(p) for n in names)
    rng = random.Random(4)
    digits = "0123456789٣९"
    values = [None, "", "ABCDE1234F", "ÀBCDE1234F", "ABCDE१२३४F", "ABCDE1234F\n", "it's a \\ quote"]
    values += ["".join(rng.choice(digits[: 10 + 2 * (i % 2)]) for _ in range(rng.choice([11, 12, 13, 16]))) for i in range(300)]
    values += ["2000 0000 0009", "4111-1111-1111-1111"]
    keys, confidences = [*fv.WEIGHTS, "unknown", None], ["HIGH", "LOW", "MEDIUM", "x", None]
    rows = [
        (v, rng.choice(keys), rng.choice(confidences), rng.choice([0, 1, 2, 5, 6, 20, 21, 100, 101, 7]), rng.randint(0, 4), rng.choice([0, 1023, 1024, 1048576, 5 * 2**40, 99]),
         rng.choice([0.0, 29.9, 30.0, 84.5, -3.2, 200.0]), rng.randint(0, 12000) / 100)
        for v in values
    ]
    schema = "v string, k string, c string, n int, t int, s long, d double, r double"
    df = spark.createDataFrame(rows, schema).withColumn("r", F.col("r").cast("decimal(18,2)"))
    c = F.col
    pairs = {
        f"{p}ascii_digits(v)": fn.ascii_digits(c("v"), profile),
        f"{p}luhn_valid(v)": fn.luhn_valid(c("v"), profile),
        f"{p}verhoeff_valid(v)": fn.verhoeff_valid(c("v"), profile),
        f"{p}pan_valid(v)": fn.pan_valid(c("v"), profile),
        f"{p}redact(v)": fn.redact(c("v")),
        f"{p}format_bytes(s)": fn.format_bytes(c("s")),
        f"{p}rule_label(k)": fn.rule_label(c("k")),
        f"{p}severity_weight(k)": fn.severity_weight(c("k")),
        f"{p}confidence_factor(c)": fn.confidence_factor(c("c")),
        f"{p}volume_multiplier(n)": fn.volume_multiplier(c("n")),
        f"{p}contribution(k, n, c)": fn.contribution(c("k"), c("n"), c("c")),
        f"{p}cooccurrence_bonus(t)": fn.cooccurrence_bonus(c("t"), profile),
        f"{p}final_score(r, {p}cooccurrence_bonus(t))": fn.final_score(c("r"), fn.cooccurrence_bonus(c("t"), profile), profile),
        f"{p}risk_level(n)": fn.risk_level(c("n")),
        f"{p}classify_tier(d)": fn.classify_tier(c("d"), profile),
    }
    for call, column in pairs.items():
        got = df.select(F.expr(call).alias("sql"), column.alias("column"))
        assert got.where("not sql <=> column").collect() == [], call
    assert "Python" not in spark.sql(f"SELECT {p}luhn_valid(v) FROM {{df}}", df=df)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        register_functions(spark, profile, "a b")


# folders


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)


def scores(df):
    return {r.filename: (r.status, r.score) for r in df.collect()}


def file_reports(loaded):
    return report(extract_text(loaded), size_bytes="size_bytes", keep=["path"])


def test_listing_sees_every_file(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(90):  # more folders than parts
        put(folder, f"d{i}/e/f{i}.txt", b"x" * i)
    put(folder, "top.txt", b"a@b.cc")
    put(folder, "_skipped/a.txt", b"x")
    put(folder, "d1/.hidden", b"x")
    put(folder, "odd name é+%20.txt", b"x")
    for address in (folder, f"file:{folder}", f"file://{folder}/"):
        rows = list_files(spark, address).collect()
        names = {r.path.rsplit("/", 1)[-1]: r.length for r in rows}
        assert names == {**{f"f{i}.txt": i for i in range(90)}, "top.txt": 6, "odd name é+%20.txt": 1} and len(rows) == 92
        assert all(r.path.startswith(address.rstrip("/")) and r.modificationTime.year >= 2020 for r in rows)
    loaded = {r.filename: r for r in load_files(list_files(spark, folder), max_bytes=50).collect()}
    assert loaded["f0.txt"].content == b"" and loaded["f50.txt"].content == b"x" * 50 and loaded["f51.txt"].content is None
    empty = str(tmp_path / "nothing")
    os.makedirs(empty)
    assert list_files(spark, empty).count() == 0


def test_an_empty_file_of_a_folder_is_rejected(spark, tmp_path):
    put(str(tmp_path), "empty.txt", b"")
    put(str(tmp_path), "full.txt", b"a@b.cc")
    read = extract_text(load_files(list_files(spark, str(tmp_path))))
    assert {r.filename: (r.http_code, r.detail) for r in read.collect()} == {"empty.txt": (400, "Uploaded file is empty."), "full.txt": (200, None)}


def test_files_that_go_before_they_are_read_are_errors(spark, tmp_path):
    put(str(tmp_path), "gone.txt", b"a@b.cc")
    rows = list_files(spark, str(tmp_path)).collect()
    os.remove(tmp_path / "gone.txt")
    listed = spark.createDataFrame(rows, "path string, modificationTime timestamp, length bigint")
    assert [r.http_code for r in extract_text(load_files(listed)).collect()] == [413]


def test_only_new_and_changed_files_are_read_again(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    read = []

    def process(loaded):
        read.append(sorted(r.filename for r in loaded.select("filename").collect()))
        return file_reports(loaded)

    def whole():
        return scores(file_reports(load_files(list_files(spark, folder))))

    put(folder, "a.txt", b"a@b.cc")
    put(folder, "b.txt", b"clean")
    put(folder, "sub/c.csv", b"")
    assert update(spark, folder, state, process) == 1 and scores(current(spark, folder, state)) == whole()
    assert update(spark, folder, state, process) == 2 and scores(current(spark, folder, state)) == whole()
    put(folder, "b.txt", b"pwd=12345678")
    put(folder, "d.txt", b"A1234567")
    os.remove(os.path.join(folder, "a.txt"))
    assert update(spark, folder, state, process) == 2 and scores(current(spark, folder, state)) == whole()
    assert read == [["a.txt", "b.txt", "c.csv"], [], ["b.txt", "d.txt"]]


def test_a_run_that_broke_off_is_made_again(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    put(folder, "a.txt", b"a@b.cc")

    def breaks(loaded):
        file_reports(loaded).write.mode("overwrite").parquet(f"{state}/results/run=1")  # written, but not in the manifest
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        update(spark, folder, state, breaks)
    put(folder, "b.txt", b"c@d.ee")
    assert update(spark, folder, state, file_reports) == 1
    assert scores(current(spark, folder, state)) == {"a.txt": ("success", 7), "b.txt": ("success", 7)}


def test_saved_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([("x/a.txt", bytearray(b"1")), ("b.txt", bytearray(b"")), ("y/z/c.txt", None)], "path string, content binary")
    assert save_files(df, str(tmp_path)) == 3 and save_files(df, f"file:{tmp_path}") == 3
    listed = list_files(spark, str(tmp_path))
    assert {r.filename: bytes(r.content) for r in load_files(listed).collect()} == {"a.txt": b"1", "b.txt": b"", "c.txt": b""}
    assert unseen(listed, listed).count() == 0


# streams


def test_deliveries_seen_before_are_dropped(spark, tmp_path):
    schema = "doc_id long, arrived timestamp, text string"
    batches = [
        [(1, 0, "a@b.cc"), (1, 5, "a@b.cc"), (2, 0, "x"), (None, 1, "n"), (None, 2, "n")],
        [(1, 60, "a@b.cc"), (1, 61, "changed"), (2, 62, "x"), (3, 63, None), (3, 64, None)],
    ]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        df = spark.createDataFrame([(i, s, t) for i, s, t in rows], "doc_id long, s long, text string")
        df.select("doc_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("arrived"), "text").coalesce(1).write.mode("append").parquet(path)
        single = once(read_stream(spark, path, schema), ["doc_id"], "arrived", "1 hour")
        start_batches(single, out, str(tmp_path / "state"), until_done=True).awaitTermination()
    got = read_batches(spark, out, spark.read.parquet(path).schema).select("doc_id", "text").collect()
    want = {(1, "a@b.cc"), (2, "x"), (None, "n"), (1, "changed"), (3, None)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    table = once(spark.read.parquet(path), ["doc_id"], "arrived", "1 hour")
    assert table.count() == len(want) and table.columns == ["doc_id", "arrived", "text"]


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    files = uploads(spark)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    files.write.parquet(path)
    results = report_stream(read_stream(spark, path, files.schema))
    for attempt in ("one", "two"):
        start_batches(results, out, str(tmp_path / attempt), ["status"], until_done=True).awaitTermination()
        rows = read_batches(spark, out, results.schema)
        assert rows.count() == 6
    assert {r.filename: r.http_code for r in rows.where("status = 'error'").collect()} == {
        "bad.exe": 400, "empty.txt": 400, "scan.pdf": 422, "big.txt": 413}
    assert sorted(os.listdir(os.path.join(out, "batch=0")))[-2:] == ["status=error", "status=success"]


def test_streamed_rollup_equals_batch_after_restart(spark, tmp_path):
    docs = corpus_texts(spark, SF, "derived").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        docs.where(F.col("doc_id") % 5 % 3 == part).coalesce(1).write.mode("append").parquet(path)
        results = exposure_by(scan(read_stream(spark, path, docs.schema), samples=False), "source", "category")
        start_batches(results, out, str(tmp_path / "state"), mode="update", until_done=True).awaitTermination()
        want = exposure_by(scan(spark.read.parquet(path), samples=False), "source", "category")
        got = latest_groups(spark, out, results.schema, ["source", "category"])
        assert sorted(got.collect()) == sorted(want.collect())


# wider roll-ups


def test_top_per_group(spark):
    rows = [(i, ["a", "b", None][i % 3] if i % 2 else "hot", "a@b.cc " * (i % 30)) for i in range(300)]
    scored = with_risk(scan(spark.createDataFrame(rows, "i int, source string, text string"), samples=False))
    ranked = top_risky_by(scored, 4, ["source"], ["i"])
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().executedPlan().toString()
    groups = defaultdict(list)
    for r in scored.collect():
        groups[r.source].append((-r.score, r.i))
    want = {(s, n + 1, i) for s, members in groups.items() for n, (_, i) in enumerate(sorted(members)[:4])}
    assert {(r.source, r["rank"], r.i) for r in ranked.collect()} == want


def test_cube_counts_each_document_once_per_group(spark):
    rng = random.Random(6)
    pool = texts(300, 22) + ["clean"] * 50
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["en", "de"]), " ".join(rng.choices(pool, k=3))) for i in range(300)]
    scanned = scan(spark.createDataFrame(rows, "i int, source string, lang string, text string"), samples=False)
    about = {r[0]: {"category": r[2], "severity": r[3]} for r in fv.RULE_ROWS}
    want = defaultdict(lambda: [set(), 0])
    for i, source, lang, text in rows:
        for key, count, _ in plain.findings(text):
            values = (source, lang, about[key]["category"], about[key]["severity"])
            for bits in range(16):
                group = tuple(None if bits >> 3 - n & 1 else v for n, v in enumerate(values))
                want[(*group, bits)][0].add(i)
                want[(*group, bits)][1] += count
    got = {tuple(r)[:5]: (r.documents, r.matches) for r in exposure_cube(scanned, ["source", "lang"], ["category", "severity"])
           .select("source", "lang", "category", "severity", "grouping", "documents", "matches").collect()}
    assert got == {k: (len(d), n) for k, (d, n) in want.items()}
    with pytest.raises(ValueError):
        exposure_cube(scanned, ["source"], ["label", "nothing"])


def test_sketches_count_distinct_values_and_merge(spark):
    rows = [(i, f"user{i % 5000}@example.com x{i}@example.org {'pwd=12345678' if i % 2 else ''}") for i in range(12_000)]
    df = spark.createDataFrame(rows, "i int, text string").withColumn("part", F.col("i") % 5)
    hashes = value_hashes(df, "salt", ["part"])
    assert all(re.fullmatch("[0-9a-f]{16}", r.value) for r in hashes.limit(50).collect())
    exact = {r.key: r.n for r in hashes.groupBy("key").agg(F.countDistinct("value").alias("n")).collect()}
    assert exact == {"email": 17_000, "password": 1}
    parts = distinct_values(hashes, ["part", "key"])
    merged = {r.key: r["values"] for r in merge_values(parts, ["key"]).collect()}
    direct = {r.key: r["values"] for r in distinct_values(hashes, ["key"]).collect()}
    for estimates in (merged, direct):
        assert estimates["password"] == 1 and abs(estimates["email"] / 17_000 - 1) < 4 * 1.04 / 64
    other = {r.value for r in value_hashes(df.limit(10), "another salt").collect()}
    assert not other & {r.value for r in value_hashes(df.limit(10), "salt").collect()}


def test_checks_are_counted_while_writing(spark, tmp_path):
    reports = assess(corpus_texts(spark, SF, "derived")).withColumn("score", F.when(F.col("doc_id") % 3 == 0, 101).otherwise(F.col("score")))
    reports = reports.withColumn("risk_level", F.when(F.col("doc_id") % 6 == 0, "ODD").otherwise(F.col("risk_level")))
    seen = write_checked(reports, str(tmp_path / "out"))
    by_check = {r.violation: r["count"] for r in report_violations(reports).groupBy("violation").count().collect()}
    assert {k: n for k, n in seen.items() if n and k not in ("rows", "broken")} == by_check
    assert seen["rows"] == reports.count() == spark.read.parquet(str(tmp_path / "out")).count()
    assert seen["broken"] == report_violations(reports).select("doc_id").distinct().count()
    none = write_checked(reports.limit(0), str(tmp_path / "none"))
    assert set(none.values()) == {0}
