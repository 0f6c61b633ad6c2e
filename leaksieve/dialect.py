"""The two scan profiles, and what each means by ``\\b``, ``\\d``, ``\\s`` and ``(?i)``.

``backend`` (the default) reads patterns with Unicode classes; ``browser`` reads
them with ASCII words and digits. Java's own ``\\b`` changed between JDK releases
and its Unicode ``\\s`` lacks four separators, so the classes are spelled out: a
pattern then finds the same matches on every JDK.
"""

from __future__ import annotations

from dataclasses import dataclass

from . import fixed_values as fv


@dataclass(frozen=True, eq=False)
class Profile:
    """Every point on which the two variants of the engine disagree."""

    name: str
    unicode: bool  # letters and digits of any alphabet, or ASCII only
    word: str  # one word character
    digit: str  # one digit
    space: str  # whitespace, as the inside of a character class
    ignore_case: str
    clean_bonus: int  # co-occurrence bonus of a document without findings
    half_even: bool  # rounding of the final score
    order_by_confidence: bool  # findings by confidence first, or by count alone
    latin1_fallback: bool  # decoding of bytes that are not UTF-8
    dotless_extension: bool  # a name without a dot is its own extension
    size_gate_first: bool  # gates in the order size, empty, extension
    utf16_length: bool  # total_characters in UTF-16 units, or in code points
    truncate_tier: bool  # classify_tier drops the fraction first
    keep_finding_key: bool  # findings of a report carry the rule key
    advice: dict
    advice_always: tuple

    def compile(self, pattern: str, ignore_case: bool = False, starts: str | None = None) -> str:
        """The Java pattern that finds what ``pattern`` means under this profile.

        ``starts`` is a character class every match begins with. Tested first, it
        spares most characters the costlier look at their neighbours. ``\\w`` and ``\\W``
        are ASCII in both profiles.
        """
        if pattern.startswith("(?i)"):
            pattern, ignore_case = pattern[4:], True
        boundary = f"(?:(?={self.word})(?<!{self.word})|(?!{self.word})(?<={self.word}))"
        first = f"(?={starts})" if starts else ""
        inner = f"(?:(?={self.word})(?<={self.word})|(?!{self.word})(?<!{self.word}))"
        outside = {"b": boundary, "B": inner, "d": self.digit, "D": f"(?!{self.digit})(?s:.)",
                   "s": f"[{self.space}]", "S": f"[^{self.space}]"}
        within = {"b": r"\x08", "d": self.digit, "s": self.space, "S": f"[^{self.space}]",
                  "D": r"\P{Nd}" if self.unicode else "[^0-9]"}
        body, in_class, at = [first], False, 0
        while at < len(pattern):
            char = pattern[at]
            if char == "\\":
                escape = pattern[at + 1 : at + 2]
                if in_class and escape == "B":
                    raise ValueError(r"\B has no meaning inside brackets")
                body.append((within if in_class else outside).get(escape, char + escape))
                at += 2
                continue
            if char == "[" and not in_class:
                in_class = True
                end = at + 1 + pattern.startswith("^", at + 1)
                if pattern.startswith("]", end):  # a bracket that comes first stands for itself
                    body.append(pattern[at:end] + r"\]")
                    at = end + 1
                    continue
            elif char == "]":
                in_class = False
            elif in_class and char in "[&":
                char = "\\" + char  # nested classes and intersections are Java's alone
            body.append(char)
            at += 1
        return (self.ignore_case if ignore_case else "") + "".join(body)


BACKEND = Profile(
    name="backend",
    unicode=True,
    word=r"[\w\p{L}\p{N}]",
    digit=r"\p{Nd}",
    space=r"\t-\r \x1c-\x1f\x85\p{Z}",
    ignore_case="(?iu)",
    clean_bonus=fv.BONUS_MANY,
    half_even=True,
    order_by_confidence=False,
    latin1_fallback=True,
    dotless_extension=False,
    size_gate_first=False,
    utf16_length=False,
    truncate_tier=True,
    keep_finding_key=False,
    advice=fv.ADVICE_BACKEND,
    advice_always=fv.ADVICE_ALWAYS_BACKEND,
)

BROWSER = Profile(
    name="browser",
    unicode=False,
    word="[A-Za-z0-9_]",
    digit="[0-9]",
    space=r"\t-\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff",
    ignore_case="(?i)",
    clean_bonus=0,
    half_even=False,
    order_by_confidence=True,
    latin1_fallback=False,
    dotless_extension=True,
    size_gate_first=True,
    utf16_length=True,
    truncate_tier=False,
    keep_finding_key=True,
    advice=fv.ADVICE_BROWSER,
    advice_always=fv.ADVICE_ALWAYS_BROWSER,
)

PROFILES = {p.name: p for p in (BACKEND, BROWSER)}


def resolve(profile: Profile | str) -> Profile:
    if isinstance(profile, Profile):
        return profile
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; choose one of {sorted(PROFILES)}")
    return PROFILES[profile]
