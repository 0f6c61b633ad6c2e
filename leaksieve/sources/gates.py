"""Input gates, quarantine and contract checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..dialect import BACKEND, Profile, resolve
from ..functions.strings import file_extension, format_bytes


def _megabytes(size: int | None) -> str:
    return f"{(size or 0) / 2**20:g} MB"


def _filled(text: str, **values: Column) -> Column:
    """A text with columns in the place of its ``{names}``."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[values[part] if i % 2 else F.lit(part) for i, part in enumerate(parts)])


def _gates(name: Column, size: Column, profile: Profile, any_extension: bool, max_bytes: int | None) -> list[tuple[Column, int, Column]]:
    """(fails, http code, detail) in the order that decides which error is reported."""
    ext = file_extension(name, profile)
    browser = profile.size_gate_first
    said = fv.GATE_TEXTS_BROWSER if browser else fv.GATE_TEXTS_BACKEND
    allowed = ", ".join(fv.ALLOWED_EXTENSIONS_BROWSER) if browser else str(list(fv.ALLOWED_EXTENSIONS))
    wrong_type = _filled(said["type"], extension=ext, allowed=F.lit(allowed))
    too_large = _filled(
        said["size"],
        size=format_bytes(size) if browser else F.format_number(size, 0),
        limit=F.lit(f"{max_bytes or 0:,}"),
        limit_mb=F.lit(_megabytes(max_bytes)),
    )
    by_type = (~ext.isin(*fv.ALLOWED_EXTENSIONS), 400, wrong_type)
    by_size = (size > max_bytes if max_bytes is not None else F.lit(False), 413, too_large)
    by_empty = (size == 0, 400, F.lit(said["empty"]))
    type_gate = [] if any_extension else [by_type]
    by_content = [(size.isNull(), 400, F.lit("File size is unknown.")), by_size, by_empty]
    return by_content + type_gate if profile.size_gate_first else type_gate + by_content


def gate(
    df: DataFrame,
    filename: str = "filename",
    size_bytes: str = "size_bytes",
    profile: Profile | str = BACKEND,
    any_extension: bool = False,
    max_bytes: int | None = fv.MAX_BYTES,
) -> DataFrame:
    """Add ``extension, status, http_code, detail``; a row that passes is ``ok`` with 200.

    Looks at the name and the size only; a null size is an error. ``any_extension``
    waives the type gate, ``max_bytes=None`` the size cap.
    """
    profile = resolve(profile)
    name = F.coalesce(F.col(filename), F.lit(""))
    code, detail = F, F
    for fails, http_code, text in _gates(name, F.col(size_bytes), profile, any_extension, max_bytes):
        code, detail = code.when(fails, http_code), detail.when(fails, text)
    return df.withColumns(
        {
            "extension": file_extension(name, profile),
            "http_code": code.otherwise(200),
            "detail": detail.otherwise(F.lit(None).cast("string")),
        }
    ).withColumn("status", F.when(F.col("http_code") == 200, "ok").otherwise("error"))


def quarantine(gated: DataFrame, filename: str = "filename") -> DataFrame:
    """The rejected rows as error records; the scan goes on without them."""
    return gated.where(F.col("status") == "error").select(
        F.col(filename).alias("filename"), "status", "http_code", "detail"
    )


def _violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows breaking a check, once per broken check. A null counts as broken."""
    broken = F.array(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    )
    return df.withColumn("violation", F.explode(F.array_compact(broken)))


def request_violations(df: DataFrame) -> DataFrame:
    """Upload metadata that breaks the input contract.

    Expects ``filename`` and ``size_bytes``; ``content_type`` gets its default.
    """
    filled = df.withColumn(
        "content_type",
        F.coalesce(F.col("content_type"), F.lit(fv.DEFAULT_CONTENT_TYPE))
        if "content_type" in df.columns
        else F.lit(fv.DEFAULT_CONTENT_TYPE),
    )
    return _violations(
        filled,
        {
            "filename_length": F.length("filename").between(1, fv.MAX_FILENAME),
            "size_range": F.col("size_bytes").between(0, fv.MAX_BYTES),
        },
    )


def normalized_level(level: Column) -> Column:
    """A level in upper case."""
    return F.upper(level)


def report_checks(reports: DataFrame) -> dict[str, Column]:
    """The output contract: what must hold for every report record, by name."""
    levels = [name for _, name in fv.LEVELS] + [fv.LEVEL_ABOVE]
    checks = {
        "score_range": F.col("score").between(0, fv.MAX_SCORE),
        "risk_level": normalized_level(F.col("risk_level")).isin(*levels),
        "total_findings": F.col("total_findings") >= 0,
        "total_characters": F.col("total_characters") >= 0,
        "cooccurrence_bonus": F.col("cooccurrence_bonus") >= 0,
    }
    if "size_bytes" in reports.columns:
        checks["size_bytes"] = F.col("size_bytes") >= 0
    if "findings" in reports.columns:
        checks["finding_count"] = F.forall("findings", lambda f: f["count"] >= 0)
    if "breakdown" in reports.columns:
        checks["breakdown_entry"] = F.forall(
            F.map_values("breakdown"), lambda e: (e["count"] >= 0) & (e["severity_weight"] >= 0)
        )
    return checks


def report_violations(reports: DataFrame) -> DataFrame:
    """Reports that break the output contract; empty for anything this engine writes."""
    return _violations(reports, report_checks(reports))
