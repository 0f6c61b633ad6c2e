"""Masking runs a pattern once over texts without a match, and places matches whatever signs stand beside them."""

import pytest
from pyspark.sql import functions as F

from leaksieve import mask
from leaksieve.dialect import BACKEND
from leaksieve.operators.masking import _places
from leaksieve.rules import RULES


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.key)
def test_each_pattern_extracts_once(spark, rule):
    made = str(_places(F.col("text"), rule, BACKEND)._jc)
    assert made.count("regexp_extract_all") == (2 if rule.compiled(BACKEND)[1] else 1)


def test_texts_that_hold_the_mark(spark):
    plain = "é a@b.cc 😀 4111 1111 1111 1111 pwd=12345678 x ann.lee@mail.example.com"
    rows = [plain, plain.replace(" ", "\x01"), f"\x01{plain}\x01", None, "clean \x01", "\x01a@b.cc\x01\x01a@b.cc"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string").coalesce(1)
    got = {r.i: r for r in mask(df).collect()}
    shown = lambda r: [(p.key, p.start, p.end) for p in r.masked]
    assert {k for k, _, _ in shown(got[0])} >= {"email", "credit_card", "password"}
    assert shown(got[2]) == [(k, a + 1, b + 1) for k, a, b in shown(got[0])]
    assert got[2].masked_text == f"\x01{got[0].masked_text}\x01"
    assert ("email", 2, 8) in shown(got[1]) and got[1].masked_text.startswith("é\x01a*****\x01")
    assert (got[3].masked_text, got[3].masked, got[4].masked_text, got[4].masked) == ("", [], "clean \x01", [])
    assert (got[5].masked_text, shown(got[5])) == ("\x01a*****\x01\x01a*****", [("email", 1, 7), ("email", 9, 15)])
