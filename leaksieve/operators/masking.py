"""Masked texts: every match in its place, replaced by its redaction.

Spark's expressions find the matches, as in the scan, and what lies between them. From
these lengths come the offsets. Putting many replacements into one text is beyond Spark's
string functions without going through the text once per match, so that step is an Arrow
function; it gets only the texts in which something was found.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..dialect import BACKEND, Profile, resolve
from ..functions.constants import constant
from ..rules import RULES, Rule
from .columns import must_be_free, quoted, spare

_MASKED = "masked string, places array<struct<start:int,end:int,idx:int>>"
#: Stands for a match while the text between matches is cut out; texts that hold it are cut by the pattern.
_MARK = "\x01"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(text: Column, rule: Rule, profile: Profile) -> Column:
    """Of each match of a rule its size (``-1 - size`` if rejected), and the characters from the match before to it.

    Null where no match is accepted: there the pattern runs once. Splitting by a pattern
    compiles it for each text, so the matches are replaced by a sign the text lacks, which is
    then split by. ``gaps`` has an entry more, for what follows the last match.
    """
    pattern, group = rule.compiled(profile)
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(_MARK))
    between = F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(F.split(marked, _MARK, -1))

    def gaps(sizes: Column) -> Column:
        if not group:
            return F.transform(between, F.length)
        # a match stands at the end of what its pattern takes
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        taken = F.zip_with(whole, sizes, lambda w, n: F.length(w) - F.when(n < 0, -1 - n).otherwise(n))
        return F.zip_with(between, taken, lambda b, more: F.length(b) + F.coalesce(more, F.lit(0)))

    def size(match: Column) -> Column:
        if rule.check is None:
            return F.length(match)
        return F.when(rule.check(match, profile), F.length(match)).otherwise(-1 - F.length(match))

    def placed(sizes: Column) -> Column:
        return F.when(F.exists(sizes, lambda n: n >= 0), F.struct(sizes.alias("sizes"), gaps(sizes).alias("gaps")))

    return _bound(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), size), placed)


def _stars(short: int):
    """The Arrow function; it holds all it needs, so workers need not have this package.

    It goes through a batch in parts, the texts of each put one after the other.
    """

    def column(values, kind):
        import numpy as np

        return values.to_numpy(zero_copy_only=False).astype(kind, copy=False) if len(values) else np.zeros(0, kind)

    def part(text, found):
        import numpy as np
        import pyarrow as pa

        hit = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
        texts = text.drop_null().to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text_at = lengths.cumsum() - lengths
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).copy()
        # lists of lists, flattened: the text of each rule found, the rule of each match
        found = found.take(pa.array(hit))
        rules = found.flatten()
        text_of = np.repeat(np.arange(len(hit)), column(found.value_lengths(), np.int64))
        places = rules.field("places")
        sizes, gaps = places.field("sizes"), places.field("gaps")
        many = column(sizes.value_lengths(), np.int64)
        size = column(sizes.flatten(), np.int64)
        rule_of = np.repeat(np.arange(len(rules)), many)
        taken, size = size >= 0, np.where(size < 0, -1 - size, size)
        # the last entry of each rule follows its last match
        gap = np.delete(column(gaps.flatten(), np.int64), (many + 1).cumsum() - 1)
        ends = (gap + size).cumsum()
        ends -= np.concatenate([[0], ends])[many.cumsum() - many][rule_of]  # from the text's start
        ends, size, rule_of = ends[taken], size[taken], rule_of[taken]
        at, idx = text_of[rule_of], column(rules.field("idx"), np.int64)[rule_of]
        starts = ends - size
        shown = np.where(size <= short, 1, 2)
        tail = np.where(size <= short, 0, 2)
        edges = np.zeros(len(code) + 1, np.int64)
        np.add.at(edges, text_at[at] + starts + shown, 1)
        np.add.at(edges, text_at[at] + np.maximum(ends - tail, starts + shown), -1)
        code[edges[:-1].cumsum() > 0] = ord("*")
        whole = code.tobytes().decode("utf-32-le")
        order = np.lexsort((idx, starts, at))
        counts = np.zeros(len(text), np.int64)
        counts[hit] = np.bincount(at, minlength=len(hit))
        offsets = np.concatenate([[0], counts.cumsum()])
        fields = [pa.array(x[order], pa.int32()) for x in (starts, ends, idx)]
        out = [None] * len(text)
        for row, a, n in zip(hit.tolist(), text_at.tolist(), lengths.tolist()):
            out[row] = whole[a : a + n]
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "idx"]))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), listed], ["masked", "places"])

    def masked(text, found):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(size.cumsum() >> 20)) + 1).tolist()  # about a megabyte each
        parts = [part(text.slice(a, b - a), found.slice(a, b - a)) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        return pa.concat_arrays(parts)

    return masked


def mask(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] | None = None,
    rules: Iterable[Rule] = RULES,
    profile: Profile | str = BACKEND,
) -> DataFrame:
    """Add ``masked_text`` and ``masked`` to the ``keep`` columns of each row.

    In ``masked_text`` every accepted match is replaced by its redaction, which is as long as
    the match, so all else keeps its place. Where matches of several rules overlap, a character
    is starred if any of their redactions stars it. ``masked`` lists all matches as
    ``key, start, end`` (characters from 0, end exclusive), by start, then in registry order;
    it holds no values.

    A null text is masked as an empty one; rows that the gates rejected get nulls, as in
    ``scan``. One row per input row, no shuffle, time and memory in line with text and matches.
    """
    profile, rules = resolve(profile), tuple(rules)
    if not rules or len({r.key for r in rules}) < len(rules):
        raise ValueError("mask needs at least one rule, and rules with different keys")
    keep = [c for c in df.columns if c != text] if keep is None else list(keep)
    must_be_free(keep, ("masked_text", "masked"), "mask")
    kept, (text_name, found_name, done_name) = quoted(keep), spare(keep, "text", "found", "done")
    whole = F.coalesce(F.col(quoted([text])[0]), F.lit(""))
    if {"status", "http_code"} <= set(df.columns):
        whole = F.when(F.col("status").eqNullSafe("ok"), whole)
    text_ = F.col(text_name)

    hints = list(dict.fromkeys(h for r in rules for h in r.hints))
    lower_name, *hint_names = spare([*keep, text_name], "lower", *[f"hint_{i}" for i in range(len(hints))])
    hinted = {h: F.col(name) for h, name in zip(hints, hint_names)}

    def found_by(i: int, rule: Rule) -> Column:
        places = _places(text_, rule, profile)
        if rule.hints:
            places = F.when(reduce(or_, [hinted[h] for h in rule.hints]), places)
        return F.struct(F.lit(i).alias("idx"), places.alias("places"))

    found = F.filter(
        F.array(*[found_by(i, r) for i, r in enumerate(rules)]),
        lambda f: f["places"].isNotNull(),
    )
    # one row in, one row out: keeps the optimizer from copying the patterns, as in scan
    prepared = df.select(*kept, whole.alias(text_name)).select(*kept, text_, F.lower(text_).alias(lower_name))
    prepared = prepared.select(*kept, text_, *[h.holds(text_, F.col(lower_name)).alias(n) for h, n in zip(hints, hint_names)])
    prepared = prepared.select(*kept, text_, F.explode(F.array(found)).alias(found_name))
    hit = F.size(found_name) > 0
    stars = F.arrow_udf(_stars(fv.REDACT_SHORT), _MASKED)
    done = prepared.select(*kept, text_, stars(F.when(hit, text_), F.when(hit, F.col(found_name))).alias(done_name))
    keys = constant([r.key for r in rules], "array<string>")
    places = F.transform(
        F.col(f"{done_name}.places"),
        lambda p: F.struct(F.get(keys, p["idx"]).alias("key"), p["start"].alias("start"), p["end"].alias("end")),
    )
    none = F.array().cast("array<struct<key:string,start:int,end:int>>")
    return done.select(
        *kept,
        F.coalesce(F.col(f"{done_name}.masked"), text_).alias("masked_text"),
        F.when(text_.isNotNull(), F.coalesce(places, none)).alias("masked"),
    )
