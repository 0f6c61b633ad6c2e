"""Files, gates, quarantine, contracts and sinks."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from leaksieve import extract_text, gate, quarantine, read_files, report, write_reports
from leaksieve.sources import (
    as_json, decode_text, report_violations, request_violations, shared_folder, text_table,
)

CAP = 10 * 1024 * 1024


def gates(spark, rows, **options):
    df = spark.createDataFrame(rows, "filename string, size_bytes bigint").coalesce(1)
    return [(r.http_code, r.status, r.detail) for r in gate(df, **options).collect()]


def test_gates(spark):
    rows = [("a.exe", 5), ("a.txt", CAP + 1), ("a.txt", CAP), ("a.txt", 0), ("a.exe", CAP + 1), ("noext", 0),
            ("A.CSV", 1), (None, 1), ("txt", 1), ("a.pdf", 3)]
    got = gates(spark, rows)
    assert [g[0] for g in got] == [400, 413, 200, 400, 400, 400, 200, 400, 400, 200]
    allowed = "Allowed: ['csv', 'docx', 'pdf', 'txt']"
    assert got[0][2] == f"Unsupported file type '.exe'. {allowed}"
    assert got[1][2] == "File too large (10,485,761 bytes). Maximum allowed size is 10,485,760 bytes (10 MB)."
    assert got[2] == (200, "ok", None)
    assert got[3][2] == "Uploaded file is empty."
    assert got[5][2] == f"Unsupported file type '.'. {allowed}"


def test_gates_browser(spark):
    rows = [("a.exe", 5), ("a.exe", CAP + 1), ("a.exe", 0), ("txt", 1)]
    got = gates(spark, rows, profile="browser")
    assert [g[0] for g in got] == [400, 413, 400, 200]
    assert [g[2] for g in got] == [
        "Unsupported file type. Allowed: txt, csv, pdf, docx", "File too large (10 MB). Maximum is 10 MB.",
        "Uploaded file is empty.", None]


def test_gates_any_extension(spark):
    assert [g[0] for g in gates(spark, [("a.log", 5), ("a.log", CAP + 1), ("b", 0)], any_extension=True)] == [200, 413, 400]


@pytest.mark.parametrize("profile, want", [
    ("backend", ["hello", "café", "café", "ï»¿é\x80", "", "\ufeffx"]),
    ("browser", ["hello", "caf�", "café", "��", "", "\ufeffx"]),
])
def test_decode(spark, profile, want):
    contents = [b"\xef\xbb\xbfhello", b"caf\xe9", "café".encode(), b"\xef\xbb\xbf\xe9\x80", b"", "\ufeff\ufeffx".encode()]
    if profile == "browser":
        want[3] = "�"  # E9 80 is one cut-short sequence
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "i int, c binary")
    got = [r[0] for r in df.orderBy("i").select(decode_text(F.col("c"), profile)).collect()]
    assert got == want


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfmail a@b.cc")
    (tmp_path / "sub" / "b.CSV").write_bytes("name;caf\xe9 x@y.zz".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF-")
    (tmp_path / "d.exe").write_bytes(b"MZ a@b.cc")
    (tmp_path / "e.txt").write_bytes(b"x" * (CAP + 1))
    (tmp_path / "f.txt").write_bytes(b"")  # Spark does not list empty files
    (tmp_path / "g.txt").write_bytes(b"a" * CAP)
    files = extract_text(read_files(spark, str(tmp_path)))
    bad = {r.filename: (r.status, r.http_code, r.detail) for r in quarantine(files).collect()}
    assert {k: v[:2] for k, v in bad.items()} == {"c.pdf": ("error", 422), "d.exe": ("error", 400), "e.txt": ("error", 413)}
    assert bad["c.pdf"][2] == "No text extraction for '.pdf' files."
    good = files.where("status = 'ok'")
    rows = {r.filename: r for r in report(good, size_bytes="size_bytes").collect()}
    assert set(rows) == {"a.txt", "b.CSV", "g.txt"}
    assert (rows["a.txt"].size_bytes, rows["a.txt"].total_characters, rows["a.txt"].score) == (14, 11, 7)
    assert rows["b.CSV"].total_characters == 16 and rows["b.CSV"].total_findings == 1
    assert rows["g.txt"].total_characters == CAP
    open_kind = {r.filename: r for r in extract_text(read_files(spark, str(tmp_path)), any_extension=True).collect()}
    assert open_kind["d.exe"].text == "MZ a@b.cc" and open_kind["d.exe"].status == "ok"


def test_content_above_the_cap_is_never_loaded(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * (CAP + 1))
    (tmp_path / "ok.txt").write_bytes(b"a@b.cc")
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", CAP)  # loading more would fail
    try:
        rows = {r.filename: r for r in extract_text(read_files(spark, str(tmp_path), max_bytes=CAP)).collect()}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    assert (rows["big.txt"].http_code, rows["ok.txt"].http_code) == (413, 200)


def test_text_extracted_elsewhere(spark):
    df = spark.createDataFrame([("a.pdf", 9, bytearray(b"%PDF"), "a@b.cc"), ("b.docx", 9, bytearray(b"PK"), None)],
                               "filename string, size_bytes bigint, content binary, extracted string")
    rows = {r.filename: r for r in extract_text(df).collect()}
    assert (rows["a.pdf"].status, rows["a.pdf"].text) == ("ok", "a@b.cc")
    assert (rows["b.docx"].status, rows["b.docx"].http_code, rows["b.docx"].text) == ("error", 422, None)


def test_names_and_sizes_need_no_content(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    df = gate(read_files(spark, str(tmp_path)).select("filename", "size_bytes"))
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_request_contract(spark):
    df = spark.createDataFrame([("", 1), ("n" * 255, CAP), ("n" * 256, CAP + 1), ("a", -1), (None, None)],
                               "filename string, size_bytes bigint")
    got = [(r.size_bytes, r.violation) for r in request_violations(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "filename_length"), (CAP + 1, "filename_length"), (CAP + 1, "size_range"), (-1, "size_range"),
        (None, "filename_length"), (None, "size_range")], key=str)
    assert request_violations(df).first().content_type == "application/octet-stream"


def test_report_contract(spark):
    df = spark.createDataFrame(
        [(50, "high", 1, 1, 0), (101, "HIGH", 1, 1, 0), (50, "SEVERE", -1, 1, 0), (0, "low", 0, 0, -1)],
        "score int, risk_level string, total_findings int, total_characters int, cooccurrence_bonus int")
    got = sorted(r.violation for r in report_violations(df).collect())
    assert got == ["cooccurrence_bonus", "risk_level", "score_range", "total_findings"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "a@b.cc"), ("b.txt", "x")], "filename string, text string")
    reports = report(df)
    out = str(tmp_path / "reports")
    write_reports(reports, out, partition_by=["risk_level"])
    assert sorted(spark.read.parquet(out).select(*reports.columns).collect()) == sorted(reports.collect())
    write_reports(reports, str(tmp_path / "json"), format="json")
    back = {r.filename: r for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert back["a.txt"].score == 7 and back["a.txt"].findings[0].samples == ["a*****"]
    record = json.loads(as_json(reports.where("filename = 'a.txt'")).first().report)
    assert record["breakdown"]["email"] == {
        "count": 1, "confidence": "MEDIUM", "severity_weight": 10, "confidence_factor": 0.7,
        "volume_multiplier": 1.0, "contribution": 7.0}


def test_text_table_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.cc"), (2, "x")], "i int, body string")
    for fmt in ("parquet", "json", "orc"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        table = text_table(spark, str(tmp_path / fmt), "body", ["i"], format=fmt)
        assert sorted(map(tuple, table.collect())) == [(1, "a@b.cc"), (2, "x")]


def test_shared_folder_follows_the_session(spark, tmp_path):
    def session_with(folder):
        conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=spark.sparkContext, _jvm=spark._jvm, _jsc=spark._jsc)

    first, second = (shared_folder(session_with(f"{tmp_path}/"), "x") for _ in range(2))
    assert first.startswith(f"{tmp_path}/x-") and first != second
    assert "leaksieve-" in shared_folder(session_with(None), "x")


def test_unread_files_are_not_reported_clean(spark, tmp_path):
    secret = b"password=hunter2secret a@b.cc "
    (tmp_path / "big.txt").write_bytes(secret + b"x" * 5000)
    (tmp_path / "bad.exe").write_bytes(secret)
    (tmp_path / "ok.txt").write_bytes(secret)
    files = extract_text(read_files(spark, str(tmp_path), max_bytes=1000))
    rows = {r.filename: r for r in report(files, size_bytes="size_bytes").collect()}
    for name in ("big.txt", "bad.exe"):
        assert (rows[name].status, rows[name].score, rows[name].risk_level, rows[name].findings) == ("error", None, None, None)
    assert rows["ok.txt"].status == "success" and rows["ok.txt"].total_findings > 0
    whole = {r.filename: r for r in report(extract_text(read_files(spark, str(tmp_path)))).collect()}
    assert whole["big.txt"].total_findings == whole["ok.txt"].total_findings


def test_unknown_size_is_an_error_and_no_score_has_no_level(spark):
    from pyspark.sql import functions as F

    from leaksieve.functions import risk_level

    df = spark.createDataFrame([("a.txt", None)], "filename string, size_bytes bigint")
    assert [(r.status, r.http_code) for r in gate(df).collect()] == [("error", 400)]
    assert df.select(risk_level(F.col("size_bytes")).alias("l")).collect()[0].l is None


def test_roll_up_refuses_columns_named_like_finding_fields(spark):
    from leaksieve import exposure_by, scan

    found = scan(spark.createDataFrame([("mine", "a@b.cc")], "category string, text string"))
    with pytest.raises(ValueError):
        exposure_by(found, "category")
