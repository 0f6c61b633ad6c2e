"""Corpus summaries: plain aggregates over scanned documents.

Every group is combined before the shuffle, so what moves is one row per task and
group: a source that holds a third of all documents is no burden. A row is a
document; counting rows therefore needs no distinct.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dialect import BACKEND, Profile, resolve
from ..rules import RULES, Rule

from .columns import must_be_free, quoted, spare
from .scan import matches
from .views import with_hits

#: What stands for the level of documents that were not read.
UNREAD = "UNREAD"


def exposure_by(scanned: DataFrame, *by: str) -> DataFrame:
    """Documents hit and matches found, by finding fields and kept columns.

    ``exposure_by(s, "key")`` per rule; ``exposure_by(s, "source", "category")`` per
    source and category, where a document counts once however many rules hit.
    """
    fields = ("key", "label", "category", "severity", "confidence")
    clash = [c for c in by if c in fields and c in scanned.columns]
    if clash:
        raise ValueError(f"kept columns are named like finding fields, rename them first: {clash}")
    unknown = [c for c in by if c not in fields and c not in scanned.columns]
    if unknown:
        raise ValueError(f"no such column or finding field: {unknown}")
    of_finding = [c for c in by if c in fields]
    of_row = [c for c in by if c not in of_finding]
    must_be_free(by, ("documents", "matches"), "exposure_by")
    total_name = spare([*by, *fields], "total")[0]
    # totals within the document first, on the array: one entry per distinct group
    groups = F.transform("findings", lambda f: F.struct(*[f[c].alias(c) for c in of_finding]))
    if of_finding:
        groups = F.array_distinct(groups)

        def total(group):
            same = lambda f: F.struct(*[f[c].alias(c) for c in of_finding]) == group
            return F.aggregate(F.filter("findings", same), F.lit(0), lambda n, f: n + f["count"])

        per_document = F.transform(
            groups, lambda g: F.struct(*[g[c].alias(c) for c in of_finding], total(g).alias(total_name))
        )
        rows = with_hits(scanned).select(*quoted(of_row), F.inline_outer(per_document))
    else:
        total_all = F.aggregate("findings", F.lit(0), lambda n, f: n + f["count"])
        rows = with_hits(scanned).select(*quoted(of_row), total_all.alias(total_name))
    return rows.groupBy(*quoted(by)).agg(
        F.count("*").alias("documents"), F.sum(total_name).alias("matches")
    )


def documents_by_level(scored: DataFrame, *by: str) -> DataFrame:
    """Documents per risk level, optionally by kept columns too; those not read count as ``UNREAD``."""
    must_be_free(by, ("risk_level", "documents"), "documents_by_level")
    level = F.coalesce("risk_level", F.lit(UNREAD)).alias("risk_level")
    return scored.groupBy(*quoted(by), level).agg(F.count("*").alias("documents"))


def top_risky(scored: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """The ``k`` documents with the highest score, ties by the ``by`` columns. Unread documents have none.

    Each task keeps only its own best ``k``; no full sort. One task merges these, so
    ``k`` is meant for reports of up to some thousand rows.
    """
    return scored.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), *quoted(by)).limit(k)


def top_risky_by(scored: DataFrame, k: int, group: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The ``k`` documents with the highest score of each group, ranked from 1, ties by the ``by`` columns.

    A limit on a rank is one that Spark applies before it shuffles, too: of each group a task
    hands on ``k`` rows, so a group with a third of all documents is no burden and no group
    is sorted as a whole. Unread documents have no score and no rank.
    """
    must_be_free([*group, *by], ("rank",), "top_risky_by")
    order = Window.partitionBy(*quoted(group)).orderBy(F.col("score").desc(), *quoted(by))
    ranked = scored.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def exposure_cube(scanned: DataFrame, row_columns: Sequence[str], finding_fields: Sequence[str] = ("category",)) -> DataFrame:
    """Documents hit and matches found for every grouping of kept columns and finding fields, totals included.

    Columns that a row sums up over are null there; ``grouping`` tells these from nulls of
    the data: one bit per column, kept ones first, the last column the lowest bit, 1 where summed up.
    A document counts once in each group. Its findings are therefore brought to one entry per
    group, for each choice of finding fields, inside the document; only then do the rows
    spread over the groupings of kept columns. Counts are combined before they are shuffled.
    """
    fields = ("key", "label", "category", "severity", "confidence")
    if not finding_fields or [c for c in finding_fields if c not in fields]:
        raise ValueError(f"finding fields are some of {fields}")
    made = ("grouping", "documents", "matches", *finding_fields)
    must_be_free(row_columns, made, "exposure_cube")
    total_name, bits_name = spare([*row_columns, *fields], "total", "bits")

    def entries(bits: int) -> Column:
        """One entry for each different choice of the fields that are kept, with the document's matches."""
        kept = [c for i, c in enumerate(reversed(finding_fields)) if not bits >> i & 1]
        nothing = F.lit(None).cast("string")
        group = lambda f: F.struct(*[(f[c] if c in kept else nothing).alias(c) for c in finding_fields])
        same = lambda g: F.filter("findings", lambda f: group(f).eqNullSafe(g))
        total = lambda g: F.aggregate(same(g), F.lit(0), lambda n, f: n + f["count"])
        return F.transform(
            F.array_distinct(F.transform("findings", group)),
            lambda g: F.struct(*[g[c].alias(c) for c in finding_fields], F.lit(bits).alias(bits_name), total(g).alias(total_name)),
        )

    every = F.concat(*[entries(bits) for bits in range(1 << len(finding_fields))])
    rows = with_hits(scanned).select(*quoted(row_columns), F.inline_outer(every))
    plain = [*finding_fields, bits_name]
    choices = [[c for i, c in enumerate(row_columns) if not bits >> i & 1] for bits in range(1 << len(row_columns))]
    sets = [[F.col(c) for c in quoted([*chosen, *plain])] for chosen in choices]
    counted = rows.groupingSets(sets, *quoted([*row_columns, *plain])).agg(
        F.grouping_id().alias("grouping"), F.count("*").alias("documents"), F.sum(total_name).alias("matches")
    )
    # the id has a bit for each column of the sets; those of finding fields never sum up there
    grouping = F.shiftright(F.col("grouping"), len(plain)) * (1 << len(finding_fields)) + F.col(bits_name)
    return counted.withColumn("grouping", grouping.cast("int")).drop(bits_name)


#: Of sketches: 2 to this power is the number of registers, whose square root rules the error.
SKETCH_BITS = 12


def value_hashes(
    df: DataFrame, salt: str, by: Sequence[str] = (), text: str = "text", rules: Iterable[Rule] = RULES,
    profile: Profile | str = BACKEND,
) -> DataFrame:
    """The ``by`` columns, ``key`` and ``value``, a salted hash, of each different value in each row's text.

    The first 16 hex digits of SHA-256 over salt and value: whoever lacks the salt cannot
    try values out. Keep the salt secret, and the same for counts that are to be merged.
    """
    profile, rules = resolve(profile), tuple(rules)
    must_be_free(by, ("key", "value"), "value_hashes")
    whole = F.coalesce(F.col(quoted([text])[0]), F.lit(""))

    def hashed(value: Column) -> Column:
        return F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 16)

    def found(rule: Rule) -> Column:
        return F.transform(
            F.array_distinct(matches(whole, rule, profile)), lambda v: F.struct(F.lit(rule.key).alias("key"), hashed(v).alias("value"))
        )

    return df.select(*quoted(by), F.inline(F.concat(*[found(r) for r in rules])))


def distinct_values(hashes: DataFrame, by: Sequence[str] = ("key",), bits: int = SKETCH_BITS) -> DataFrame:
    """How many different values each group exposes: ``sketch`` and its estimate ``values``.

    Sketches of days or sources can be stored and merged (``merge_values``) without the values.
    A task hands on one sketch per group, of some kilobytes however many values there are.
    """
    must_be_free(by, ("sketch", "values"), "distinct_values")
    sketched = hashes.groupBy(*quoted(by)).agg(F.hll_sketch_agg("value", bits).alias("sketch"))
    return sketched.withColumn("values", F.hll_sketch_estimate("sketch"))


def merge_values(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of parts as sketches of wholes, with their estimates."""
    merged = sketches.groupBy(*quoted(by)).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("values", F.hll_sketch_estimate("sketch"))
