"""The scan: text in, findings out, one row per document and no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..dialect import BACKEND, Profile, resolve
from ..functions.constants import constant
from ..functions.strings import redact, text_length
from ..rules import RULES, Hint, Rule
from .columns import must_be_free, quoted, spare

_ABOUT = ("key", "label", "category", "severity", "confidence")
_CONFIDENCE_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


def matches(text: Column, rule: Rule, profile: Profile | str = BACKEND) -> Column:
    """Every accepted whole match of one rule, in text order.

    Raw values: use inside larger expressions, never as an output column.
    """
    profile = resolve(profile)
    pattern, group = rule.compiled(profile)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if rule.check is not None:
        found = F.filter(found, lambda value: rule.check(value, profile))
    return found


def _findings(
    text: Column, rules: Sequence[Rule], profile: Profile, hinted: dict[Hint, Column], samples: bool
) -> Column:
    nothing = F.array().cast("array<string>")

    def found_by(rule: Rule) -> Column:
        found = matches(text, rule, profile)
        if not rule.hints:
            return found
        worthwhile = reduce(or_, [hinted[h] for h in rule.hints])
        return F.when(worthwhile, found).otherwise(nothing)

    per_rule = F.array(*[found_by(r) for r in rules])
    fields = ", ".join(f"{name}: string" for name in _ABOUT)
    about = constant(
        [{name: getattr(r, name) for name in _ABOUT} for r in rules], f"array<struct<{fields}>>"
    )
    def shown(found: Column) -> list[Column]:
        distinct = F.slice(F.array_distinct(found), 1, fv.MAX_SAMPLES)
        return [F.transform(distinct, redact).alias("samples")] if samples else []

    # one lambda for all rules: each match list is bound once, counted and sampled
    counted = F.transform(
        per_rule,
        lambda found, idx: F.struct(
            _rank(idx, rules, profile).alias("rank"),
            (-F.size(found)).alias("neg_count"),
            idx.alias("idx"),
            F.get(about, idx).alias("about"),
            *shown(found),
        ),
    )
    hits = F.array_sort(F.filter(counted, lambda f: f["neg_count"] < 0))
    return F.transform(
        hits,
        lambda f: F.struct(
            *[f["about"][name].alias(name) for name in _ABOUT],
            (-f["neg_count"]).alias("count"),
            *([f["samples"].alias("samples")] if samples else []),
        ),
    )


def _rank(idx: Column, rules: Sequence[Rule], profile: Profile) -> Column:
    """What findings are sorted by before their count."""
    if not profile.order_by_confidence:
        return F.lit(0)
    ranks = [_CONFIDENCE_RANK.get(r.confidence, len(_CONFIDENCE_RANK)) for r in rules]
    return F.get(constant(ranks, "array<int>"), idx)


def scan(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] | None = None,
    rules: Iterable[Rule] = RULES,
    profile: Profile | str = BACKEND,
    samples: bool = True,
) -> DataFrame:
    """Add ``total_characters`` and ``findings`` to the ``keep`` columns of each row.

    ``findings`` holds one entry per rule that matched: ``key, label, category,
    severity, confidence, count, samples``. Every occurrence counts; samples are
    the first three distinct values, redacted (``samples=False`` leaves them out, for
    roll-ups and scores that never show them). Entries come by count, ties in
    registry order (backend), or by confidence and then count (browser).

    ``keep`` defaults to every column but the text. A null text is scanned as an
    empty one. Where the input went through the gates (it has ``status`` and ``http_code``),
    rows that are not ``ok`` were not read: their results are null, which no operator takes
    for clean. Kept columns named ``findings`` or ``total_characters`` raise an error. The
    rows are neither shuffled nor reordered, so the same call serves a table and a stream.
    """
    profile, rules = resolve(profile), tuple(rules)
    if not rules or len({r.key for r in rules}) < len(rules):
        raise ValueError("scan needs at least one rule, and rules with different keys")
    keep = [c for c in df.columns if c != text] if keep is None else list(keep)
    must_be_free(keep, ("total_characters", "findings"), "scan")
    hints = list(dict.fromkeys(h for r in rules for h in r.hints))
    text_name, lower_name, *hint_names = spare(keep, "text", "lower", *[f"hint_{i}" for i in range(len(hints))])
    text_, lower, kept = F.col(text_name), F.col(lower_name), quoted(keep)
    whole = F.coalesce(F.col(quoted([text])[0]), F.lit(""))
    if {"status", "http_code"} <= set(df.columns):
        whole = F.when(F.col("status").eqNullSafe("ok"), whole)
    prepared = df.select(*kept, whole.alias(text_name))
    prepared = prepared.select(*kept, text_, F.lower(text_).alias(lower_name)).select(
        *kept,
        text_,
        text_length(text_, profile).cast("int").alias("total_characters"),
        *[h.holds(text_, lower).alias(name) for h, name in zip(hints, hint_names)],
    )
    hinted = {h: F.col(name) for h, name in zip(hints, hint_names)}
    found = _findings(text_, rules, profile, hinted, samples)
    # explode(array(x)) is one row in, one row out. It stops the optimizer from
    # copying the patterns into later filters and projections, so that each
    # pattern runs once per document whatever is done with the findings.
    return prepared.select(
        *kept, "total_characters", F.explode(F.array(F.when(text_.isNotNull(), found))).alias("findings")
    )
