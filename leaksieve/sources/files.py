"""Folders of files: listing, gating and decoding to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..dialect import BACKEND, Profile, resolve
from .gates import gate

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(
    spark: SparkSession, folder: str, streaming: bool = False, files_per_batch: int = 10000,
    max_bytes: int | None = None,
) -> DataFrame:
    """The files under a folder as ``filename, size_bytes, content, path``.

    Every file is loaded. With ``max_bytes``, larger ones are listed with a null content
    that is never loaded; ``extract_text`` makes errors (413) of them, whatever cap it
    has itself. Spark leaves out empty files when it lists a folder, so the empty-file
    gate can only act on tables that carry a size.
    """
    if streaming:
        reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = spark.read.format("binaryFile")
    files = reader.option("recursiveFileLookup", True).load(folder)
    if max_bytes is not None:
        # a condition on the length reaches the reader, which then skips the content
        large = files.where(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
        files = files.where(F.col("length") <= max_bytes).unionByName(large)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size_bytes"),
        "content",
        "path",
    )


def _best_effort(content: Column) -> Column:
    """UTF-8 with replacement characters; a byte order mark stays."""
    return F.make_valid_utf8(content.cast("string"))


def decode_text(content: Column, profile: Profile | str = BACKEND) -> Column:
    """Bytes to text: UTF-8 without its byte order mark.

    Bytes that are not UTF-8 are read as Latin-1 (backend) or get replacement
    characters (browser).
    """
    mark = F.lit("\ufeff")
    decoded = _best_effort(content)
    unmarked = F.when(
        F.startswith(decoded, mark), F.substring(decoded, 2, 2**31 - 1)
    ).otherwise(decoded)
    if not resolve(profile).latin1_fallback:
        return unmarked
    return F.when(F.is_valid_utf8(content.cast("string")), unmarked).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def extract_text(
    files: DataFrame, profile: Profile | str = BACKEND, any_extension: bool = False,
    max_bytes: int | None = fv.MAX_BYTES,
) -> DataFrame:
    """Gate files and decode the text kinds: adds the gate columns and ``text``.

    Rejected rows have no text. Files of the other two allowed kinds need a parser
    this engine does not carry; they become errors with code 422, unless the input
    has an ``extracted`` column that holds their text. ``any_extension`` waives the
    type gate and decodes other kinds as well as possible, ``max_bytes=None`` the size
    cap. A file whose content was not loaded is an error with code 413.
    """
    gated = gate(files, profile=profile, any_extension=any_extension, max_bytes=max_bytes)
    passed = F.col("status") == "ok"
    is_text = F.col("extension").isin(*fv.TEXT_EXTENSIONS)
    is_parsed = F.col("extension").isin(*fv.ALLOWED_EXTENSIONS) & ~is_text
    given = F.col("extracted") if "extracted" in files.columns else F.lit(None).cast("string")
    text = (
        F.when(is_text, decode_text(F.col("content"), profile))
        .when(is_parsed, given)
        .otherwise(_best_effort(F.col("content")))
    )
    unreadable = passed & is_parsed & given.isNull()
    unloaded = passed & ~is_parsed & F.col("content").isNull()
    reason = F.concat(F.lit("No text extraction for '."), F.col("extension"), F.lit("' files."))
    return gated.withColumns(
        {
            "text": F.when(passed, text),
            "status": F.when(unreadable | unloaded, "error").otherwise(F.col("status")),
            "http_code": F.when(unreadable, 422).when(unloaded, 413).otherwise(F.col("http_code")),
            "detail": F.when(unreadable, reason)
            .when(unloaded, F.lit("The content was not loaded."))
            .otherwise(F.col("detail")),
        }
    ).drop("content")
