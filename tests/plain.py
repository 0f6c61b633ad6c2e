"""Brute force in plain Python: what the Spark engine must agree with."""

import re

from leaksieve import fixed_values as fv


def luhn(value):
    digits = [int(c) for c in value if c.isdecimal()]
    doubled = [d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(digits[::-1])]
    return len(digits) >= 13 and sum(doubled) % 10 == 0


def verhoeff(value):
    digits = [int(c) for c in value if c.isdecimal()]
    if len(digits) != 12:
        return False
    check = 0
    for i, digit in enumerate(digits[::-1]):
        check = fv.VERHOEFF_D[check][fv.VERHOEFF_P[i % 8][digit]]
    return check == 0


def redact(value):
    shown = 1 if len(value) <= 6 else 4
    stars = "*" * (len(value) - shown)
    return value[:1] + stars if shown == 1 else value[:2] + stars + value[-2:]


CHECKS = {"aadhaar": verhoeff, "credit_card": luhn}
COMPILED = {k: re.compile(p) for k, p in fv.PATTERNS.items()}
COMPILED_BROWSER = {
    k: re.compile(p, re.ASCII | (re.IGNORECASE if k in fv.BROWSER_IGNORE_CASE else 0))
    for k, p in fv.PATTERNS.items()
}


def matches(key, text, browser=False):
    pattern = (COMPILED_BROWSER if browser else COMPILED)[key]
    found = [m.group(0) for m in pattern.finditer(text)]
    return [m for m in found if CHECKS.get(key, lambda _: True)(m)]


def findings(text, browser=False):
    rank = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
    out = []
    for i, (key, *_, confidence) in enumerate(fv.RULE_ROWS):
        found = matches(key, text, browser)
        if found:
            samples = [redact(m) for m in list(dict.fromkeys(found))[:3]]
            order = (rank[confidence] if browser else 0, -len(found), i)
            out.append((order, key, len(found), samples))
    return [f[1:] for f in sorted(out)]
