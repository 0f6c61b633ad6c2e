"""Hand-derived values of every scalar."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import plain
from leaksieve.functions import (
    classify_tier,
    confidence_factor,
    contribution,
    cooccurrence_bonus,
    file_extension,
    final_score,
    format_bytes,
    luhn_valid,
    pan_valid,
    redact,
    risk_level,
    rule_label,
    severity_weight,
    text_length,
    verhoeff_valid,
    volume_multiplier,
)


def apply(spark, fn, values, type_name="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    return [r[0] for r in df.coalesce(1).orderBy("i").select(fn(F.col("v"))).collect()]


def check(spark, fn, pairs, type_name="string"):
    assert apply(spark, fn, [v for v, _ in pairs], type_name) == [w for _, w in pairs]


def test_luhn(spark):
    check(spark, luhn_valid, [
        ("4111111111111111", True), ("4111 1111 1111 1111", True), ("4111-1111-1111-1111", True),
        ("4111111111111112", False), ("79927398713", False), ("0000000000000", True), ("", False),
        ("٤١١١١١١١١١١١١١١١", True), ("４１１１ １１１１ １１１１ １１１２", False),
        ("𝟒𝟏𝟏𝟏𝟏𝟏𝟏𝟏𝟏𝟏𝟏𝟏𝟏𝟏𝟏𝟏", True),
    ])
    # the browser profile knows ASCII digits only
    assert apply(spark, lambda v: luhn_valid(v, "browser"), ["٤١١١١١١١١١١١١١١١"]) == [False]


def test_verhoeff(spark):
    check(spark, verhoeff_valid, [
        ("200000000009", True), ("200000000013", True), ("200000000021", True),
        ("200000000000", False), ("2000 0000 0009", True), ("20000000000", False),
        ("2000000000090", False), ("", False), ("２０００００００００１３", True),
    ])


def test_checksums_random(spark):
    rng = random.Random(7)
    numbers = ["".join(rng.choices("0123456789", k=rng.choice([12, 12, 13, 16, 19]))) for _ in range(4000)]
    assert apply(spark, luhn_valid, numbers) == [plain.luhn(n) for n in numbers]
    assert apply(spark, verhoeff_valid, numbers) == [plain.verhoeff(n) for n in numbers]
    assert 100 < sum(map(plain.verhoeff, numbers)) < 400


def test_pan(spark):
    check(spark, pan_valid, [
        ("ABCDE1234F", True), ("ABCDE1234f", False), ("aBCDE1234F", False), ("ABCDE1234", False),
        ("ABCDE1234F\n", False), ("ABCD11234F", False), ("ABCDE12345", False), ("", False),
        ("ÀBCDE1234Ü", True), ("ABCDÉ١٢٣٤F", True), ("中BCDE1234F", True), ("中中中中中1234F", False),
    ])
    check(spark, lambda v: pan_valid(v, "browser"), [
        ("ABCDE1234F", True), ("ÀBCDE1234F", False), ("ABCDE١٢٣٤F", False), ("ABCDE1234F\n", False),
    ])


def test_redact(spark):
    check(spark, redact, [
        ("abc", "a**"), ("abcdef", "a*****"), ("abcdefg", "ab***fg"), ("a", "a"), ("", ""),
        ("éjohn@x.com", "éj*******om"),
    ])


def test_format_bytes(spark):
    check(spark, format_bytes, [
        (0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"),
        (1280, "1.3 KB"), (1024**2 - 1, "1024 KB"), (1024**2, "1 MB"), (10 * 1024**2, "10 MB"),
        (5 * 1024**3 // 2, "2.5 GB"), (2048 * 1024**3, "2048 GB"), (100 * 1024**4, "102400 GB"),
    ], "bigint")


def test_labels_and_lengths(spark):
    check(spark, rule_label, [("db_conn", "DB CONN"), ("email", "EMAIL"), ("a_b_c", "A B C")])
    check(spark, text_length, [("", 0), ("abc", 3), ("é𝟎", 2)])
    check(spark, lambda v: text_length(v, "browser"), [("", 0), ("abc", 3), ("é𝟎", 3)])


def test_file_extension(spark):
    names = ["a.TXT", "a.b.csv", "txt", "a.", ".pdf", "", "a.tar.gz"]
    assert apply(spark, file_extension, names) == ["txt", "csv", "", "", "pdf", "", "gz"]
    assert apply(spark, lambda v: file_extension(v, "browser"), names) == [
        "txt", "csv", "txt", "", "pdf", "", "gz"]


def test_volume(spark):
    check(spark, volume_multiplier, [
        (n, Decimal(w)) for n, w in [
            (0, "0.0"), (1, "1.0"), (2, "1.3"), (5, "1.3"), (6, "1.6"), (20, "1.6"), (21, "2.0"),
            (100, "2.0"), (101, "2.5"), (10**6, "2.5")]
    ], "int")


def test_lookups(spark):
    check(spark, severity_weight, [("aadhaar", 35), ("email", 10), ("password", 20), ("nope", 10), (None, 10)])
    check(spark, confidence_factor, [
        (c, Decimal(w)) for c, w in [("HIGH", "1.0"), ("MEDIUM", "0.7"), ("LOW", "0.4"), ("x", "0.7"), (None, "0.7")]])
    rows = [("aadhaar", 3, "HIGH", "45.50"), ("email", 5, "MEDIUM", "9.10"), ("nope", 1, None, "7.00"),
            ("phone_in", 1, "MEDIUM", "10.50"), ("email", 0, "HIGH", "0.00"), ("jwt", 2, "HIGH", "32.50")]
    df = spark.createDataFrame(rows, "k string, n int, c string, want string").coalesce(1)
    got = df.select(contribution(F.col("k"), F.col("n"), F.col("c")), "want").collect()
    assert all(g == Decimal(w) for g, w in got)


def test_bonus(spark):
    check(spark, cooccurrence_bonus, [(0, 12), (1, 0), (2, 5), (3, 12), (12, 12)], "int")
    check(spark, lambda v: cooccurrence_bonus(v, "browser"), [(0, 0), (1, 0), (2, 5), (3, 12)], "int")


@pytest.mark.parametrize("profile, want", [
    ("backend", [12, 10, 32, 84, 52, 100, 94]), ("browser", [12, 11, 33, 85, 53, 100, 95])])
def test_final_score(spark, profile, want):
    raws = [Decimal(x) for x in ("12.00", "10.50", "32.50", "84.50", "52.50", "480.00", "94.50")]
    assert apply(spark, lambda v: final_score(v, F.lit(0), profile), raws, "decimal(18,2)") == want


def test_levels(spark):
    check(spark, risk_level, [
        (0, "LOW"), (29, "LOW"), (30, "MEDIUM"), (59, "MEDIUM"), (60, "HIGH"), (84, "HIGH"),
        (85, "CRITICAL"), (100, "CRITICAL")], "int")
    check(spark, classify_tier, [
        (29.9, "LOW"), (30.0, "MEDIUM"), (84.99, "HIGH"), (85.0, "CRITICAL"), (-0.5, "LOW")], "double")
    check(spark, lambda v: classify_tier(v, "browser"), [
        (29.0, "LOW"), (29.9, "MEDIUM"), (84.99, "CRITICAL"), (-0.5, "LOW")], "double")
