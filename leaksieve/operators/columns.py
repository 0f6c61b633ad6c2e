"""Column names: those an operator adds must be free, those it uses inside must not meet any other."""

from __future__ import annotations

from collections.abc import Iterable


def must_be_free(present: Iterable[str], made: Iterable[str], what: str) -> None:
    """Raises where kept columns are named like columns that ``what`` makes; Spark takes names in any case."""
    made = {c.lower() for c in made}
    clash = [c for c in present if c.lower() in made]
    if clash:
        raise ValueError(f"{what} makes columns of these names, rename the kept ones first: {clash}")


def spare(present: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, longer than every name present and so different from all."""
    longest = max(map(len, present), default=0)
    return ["_" * longest + c for c in wanted]


def quoted(names: Iterable[str]) -> list[str]:
    """Names as Spark takes them whatever signs they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in names]
