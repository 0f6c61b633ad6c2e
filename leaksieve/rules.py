"""The rule registry: what to look for, how to check it and how much it weighs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv
from .dialect import Profile
from .functions.checks import luhn_valid, pan_valid, verhoeff_valid


@dataclass(frozen=True)
class Hint:
    """Something a text must contain for a rule to match: a word or a cheap pattern.

    A word in ``any_case`` is written in lower case.
    """

    contains: str
    any_case: bool = False
    is_pattern: bool = False

    def holds(self, text: Column, lower_text: Column) -> Column:
        if self.is_pattern:
            return text.rlike(self.contains)
        return F.contains(lower_text if self.any_case else text, F.lit(self.contains))


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``check`` is a Column function applied to each match. ``hints`` and ``starts``
    only save work: every match must contain one of the hints (none given: any text
    may match) and begin with a character of the class ``starts``. Texts without a
    hint skip the pattern; a hint named by several rules is looked for once.
    ``scan_pattern`` may give an equivalent of ``pattern``, its group 1 being the
    match, that takes time proportional to the text where ``pattern`` does not.
    ``advice`` is what to recommend where the rule matched, ``browser_advice`` its other
    wording for the browser profile; without one, the profile's own text for the key holds.
    """

    key: str
    label: str
    category: str
    severity: str
    confidence: str
    pattern: str
    check: Callable[[Column, Profile], Column] | None = None
    weight: int = fv.DEFAULT_WEIGHT
    hints: tuple[Hint, ...] = ()
    starts: str | None = None
    scan_pattern: str | None = None
    browser_ignore_case: bool = False
    advice: str | None = None
    browser_advice: str | None = None

    def advice_in(self, profile: Profile) -> str | None:
        """The recommendation for this rule under a profile."""
        own = self.advice if profile.unicode else self.browser_advice or self.advice
        return own or profile.advice.get(self.key)

    def compiled(self, profile: Profile) -> tuple[str, int]:
        """The Java pattern to scan with, and the group that holds the match."""
        ignore_case = self.browser_ignore_case and not profile.unicode
        pattern, group = (self.scan_pattern, 1) if self.scan_pattern else (self.pattern, 0)
        return profile.compile(pattern, ignore_case, self.starts), group


_DIGIT_RUN = (Hint(r"\p{Nd}{4}", is_pattern=True),)


def _words(*words: str) -> tuple[Hint, ...]:
    return tuple(Hint(w) for w in words)


def _any_case(*words: str) -> tuple[Hint, ...]:
    # Lower-casing maps every character that a case-insensitive pattern takes for an
    # ASCII letter to that letter, but for two: the dotted and dotless i, which no
    # word here contains, and the long s, which counts as a hint by itself.
    return (*(Hint(w, any_case=True) for w in words), Hint("\u017f"))


_HINTS = {
    "email": _words("@"),
    "phone_in": _DIGIT_RUN,
    "pan": _DIGIT_RUN,
    "aadhaar": _DIGIT_RUN,
    "passport": _DIGIT_RUN,
    "credit_card": _DIGIT_RUN,
    "api_key": _any_case("key", "secret"),
    "aws_access": (),  # its first letter is selective enough
    "aws_secret": _any_case("secret"),
    "jwt": _words("eyJ"),
    "password": _any_case("passw", "pwd", "secret", "token", "key"),
    "db_conn": _words("://"),
}
_STARTS = {
    "phone_in": "[+0-9]",
    "pan": "[A-Z]",
    "aadhaar": "[2-9]",
    "passport": "[A-Z]",
    "credit_card": "[3-6]",
    "api_key": "[a]",
    "aws_access": "[A]",
    "aws_secret": "[a]",
    "password": "[pst]",
    "db_conn": "[pmrosa]",
}
# Both patterns begin with a run of characters that either is followed by the right
# sign (@ or a dot) or not, whichever of its characters a match would begin with. So
# they are tried once per run, at the first place after the run's start or after the
# previous match where they can begin, instead of at every such place: long runs of
# encoded data cost one pass, not one pass per place.
_LOCAL = r"[\w.%+\-]"  # \w is ASCII in both profiles
_PART = r"[\w\-]"
_SCAN_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G)(?={_LOCAL}++@)(?>{_LOCAL}*?\b)({_LOCAL}++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b)",
    "jwt": rf"(?:(?<!{_PART})|\G)(?={_PART}++\.)(?>{_PART}*?(?=eyJ)\b)(eyJ{_PART}++\.{_PART}+\.{_PART}+\b)",
}
_CHECKS = {"pan": pan_valid, "aadhaar": verhoeff_valid, "credit_card": luhn_valid}

RULES: tuple[Rule, ...] = tuple(
    Rule(
        *row,
        pattern=fv.PATTERNS[row[0]],
        check=_CHECKS.get(row[0]),
        weight=fv.WEIGHTS[row[0]],
        hints=_HINTS[row[0]],
        starts=_STARTS.get(row[0]),
        scan_pattern=_SCAN_PATTERNS.get(row[0]),
        browser_ignore_case=row[0] in fv.BROWSER_IGNORE_CASE,
    )
    for row in fv.RULE_ROWS
)


def rule_keys(rules: Iterable[Rule] = RULES) -> list[str]:
    return [r.key for r in rules]


def with_rules(*added: Rule, base: Iterable[Rule] = RULES) -> tuple[Rule, ...]:
    """The registry with rules replaced (same key, same place) or appended."""
    by_key = {r.key: r for r in base}
    by_key.update({r.key: r for r in added})
    return tuple(by_key.values())


def only_rules(*keys: str, base: Iterable[Rule] = RULES) -> tuple[Rule, ...]:
    """The registry cut down to some keys, in registry order."""
    base = tuple(base)
    unknown = set(keys) - {r.key for r in base}
    if unknown:
        raise ValueError(f"no such rule: {sorted(unknown)}")
    return tuple(r for r in base if r.key in keys)


def weights_of(rules: Iterable[Rule]) -> dict[str, int]:
    return {r.key: r.weight for r in rules}


def rule_catalog(spark: SparkSession, rules: Iterable[Rule] = RULES) -> DataFrame:
    """One row per rule: the registry as a small dimension table."""
    rows = [
        (i, r.key, r.label, r.category, r.severity, r.confidence, r.weight, r.check is not None)
        for i, r in enumerate(rules)
    ]
    schema = (
        "rule_idx int, key string, label string, category string, severity string, "
        "confidence string, severity_weight int, has_validator boolean"
    )
    return spark.createDataFrame(rows, schema)


def coverage(spark: SparkSession) -> DataFrame:
    """The twelve coverage entries in display order, each with the rule behind it."""
    rows = [(i, *row) for i, row in enumerate(fv.COVERAGE_ROWS, 1)]
    return spark.createDataFrame(rows, "position int, key string, label string, category string, confidence string")
