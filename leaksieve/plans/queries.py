"""The registered queries: every operator, run over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    classify_tier,
    confidence_factor,
    contribution,
    cooccurrence_bonus,
    file_extension,
    final_score,
    format_bytes,
    luhn_valid,
    pan_valid,
    redact,
    register_functions,
    risk_level,
    rule_label,
    severity_weight,
    text_length,
    verhoeff_valid,
    volume_multiplier,
)
from ..operators import (
    breakdown_of,
    breakdown_table,
    distinct_values,
    documents_by_level,
    exposure_by,
    exposure_cube,
    findings_table,
    legacy_score,
    mask,
    merge_values,
    numbered_recommendations,
    sample_table,
    scan,
    score_findings,
    top_risky,
    top_risky_by,
    value_hashes,
    with_flags,
    with_recommendations,
    with_risk,
)
from ..rules import Hint, Rule, coverage, only_rules, rule_catalog, rule_keys, with_rules
from ..sources import (
    as_json,
    current,
    decode_text,
    extract_text,
    gate,
    list_files,
    load_files,
    quarantine,
    report_violations,
    request_violations,
    save_files,
    shared_folder,
    spread,
    update,
    write_checked,
)
from ..streaming import latest_groups, once, read_batches, read_stream, report_stream, start_batches, start_scan
from .corpus import TABLES, keys_of, texts
from .inputs import derive
from .report import assess, flat_report, report, scan_log

Query = Callable[[SparkSession, str], DataFrame]
FILE_KINDS = (".txt", ".CSV", ".pdf", ".txt", ".exe", "", ".Docx")
UPLOAD_CAP = 5000  # bytes, small enough for many documents to exceed it
SECRETS = ("api_key", "aws_access", "aws_secret", "jwt", "password", "db_conn")


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _scanned(spark, sf_dir, corpus, **options) -> DataFrame:
    return scan(texts(spark, sf_dir, corpus), **options)


def _scored(spark, sf_dir, corpus, profile="backend") -> DataFrame:
    return with_risk(_scanned(spark, sf_dir, corpus, profile=profile, samples=False), profile=profile)


def _flat(corpus: str, profile: str = "backend") -> Query:
    return lambda spark, sf_dir: flat_report(
        assess(texts(spark, sf_dir, corpus), profile=profile), keys_of(corpus)
    )


def _joined_samples(df: DataFrame) -> DataFrame:
    return df.withColumn("samples", F.array_join("samples", " | "))


def _detect(key: str) -> Query:
    def query(spark, sf_dir):
        found = _scanned(spark, sf_dir, "derived", rules=only_rules(key))
        return _joined_samples(findings_table(found, ["doc_id"])).select("doc_id", "count", "samples")

    return query


def _detect_all(corpus: str) -> Query:
    def query(spark, sf_dir):
        keys = keys_of(corpus)
        found = findings_table(_scanned(spark, sf_dir, corpus), keys)
        return _joined_samples(found).select(*keys, "key", "count", "samples")

    return query


def findings_long(spark, sf_dir):
    return _joined_samples(findings_table(_scanned(spark, sf_dir, "derived"), ["doc_id"]))


def _findings_order(profile: str) -> Query:
    def query(spark, sf_dir):
        scanned = _scanned(spark, sf_dir, "derived", profile=profile)
        keys = F.array_join(F.transform("findings", lambda f: f["key"]), ",")
        return scanned.where(F.size("findings") > 0).select("doc_id", keys.alias("keys"))

    return query


def _samples(corpus: str) -> Query:
    return lambda spark, sf_dir: sample_table(_scanned(spark, sf_dir, corpus), keys_of(corpus))


def sensitive_flag(spark, sf_dir):
    flagged = with_flags(with_risk(_scanned(spark, sf_dir, "documents")))
    return flagged.select("doc_id", "sensitive", "total_findings")


def text_length_browser(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select(
        "doc_id",
        text_length(F.col("text"), "browser").alias("total_characters"),
        text_length(F.col("text")).alias("code_points"),
    )


def secrets_only(spark, sf_dir):
    rules = only_rules(*SECRETS)
    scored = with_risk(_scanned(spark, sf_dir, "derived", rules=rules), rules)
    return scored.select(
        "doc_id", "total_findings", F.size("findings").alias("types"), "score", "risk_level"
    )


def _own_rules() -> tuple[Rule, ...]:
    """The whole registry with one rule added and one replaced."""
    return with_rules(
        Rule("closing", "Closing word", "Notes", "low", "LOW", r"\s+end\b", weight=50,
             hints=(Hint("end"),), advice="Check the closing notes."),
        Rule("email", "Internal address", "PII", "medium", "HIGH", r"\bu\d+@mail\.example\.com\b", weight=30,
             hints=(Hint("@"),)),
    )


def custom_rule(spark, sf_dir):
    rules = _own_rules()
    scored = with_risk(_scanned(spark, sf_dir, "derived", rules=rules, samples=False), rules)
    return findings_table(scored, ["doc_id", "score"]).select("doc_id", "score", "position", "key", "label", "count")


def recommendations_custom(spark, sf_dir):
    rules = _own_rules()
    advised = with_recommendations(_scanned(spark, sf_dir, "derived", rules=rules, samples=False), rules)
    return numbered_recommendations(advised, ["doc_id"])


def rule_catalog_usage(spark, sf_dir):
    # the catalog has one row per rule and the roll-up at most as many
    hits = exposure_by(_scanned(spark, sf_dir, "derived", samples=False), "key")
    return rule_catalog(spark).join(hits, "key", "left").fillna(0, ["documents", "matches"])


def coverage_usage(spark, sf_dir):
    hits = exposure_by(_scanned(spark, sf_dir, "documents", samples=False), "key").drop("matches")
    return coverage(spark).join(hits, "key", "left").fillna(0, ["documents"]).drop("key")


def luhn(spark, sf_dir):
    return derive(spark, sf_dir, "card_numbers").select(
        "o_orderkey", luhn_valid(F.col("number")).alias("valid")
    )


def verhoeff(spark, sf_dir):
    return derive(spark, sf_dir, "identity_numbers").select(
        "o_orderkey", verhoeff_valid(F.col("number")).alias("valid")
    )


def pan_structure(spark, sf_dir):
    return derive(spark, sf_dir, "tax_codes").select(
        "o_orderkey", pan_valid(F.col("code")).alias("valid")
    )


def redacted(spark, sf_dir):
    return derive(spark, sf_dir, "names").select(
        "c_custkey", redact(F.col("value")).alias("redacted")
    )


def human_sizes(spark, sf_dir):
    return derive(spark, sf_dir, "sizes").select(
        "l_orderkey",
        "l_linenumber",
        format_bytes(F.col("size_bytes")).alias("shown"),
        format_bytes(F.col("price")).alias("price_shown"),
    )


def labels(spark, sf_dir):
    return (
        derive(spark, sf_dir, "line_findings")
        .groupBy("key")
        .agg(F.count("*").alias("n"))
        .select("key", rule_label(F.col("key")).alias("label"), "n")
    )


def extensions(spark, sf_dir):
    return derive(spark, sf_dir, "uploads").select(
        "o_orderkey",
        file_extension(F.col("dotted")).alias("extension"),
        file_extension(F.col("dotless")).alias("dotless"),
        file_extension(F.col("dotless"), "browser").alias("dotless_browser"),
    )


def volumes(spark, sf_dir):
    return derive(spark, sf_dir, "counts").select(
        "l_orderkey", "n", volume_multiplier(F.col("n")).cast("double").alias("multiplier")
    )


def contributions(spark, sf_dir):
    key, count, confidence = F.col("key"), F.col("count"), F.col("confidence")
    return derive(spark, sf_dir, "line_findings").select(
        "l_orderkey",
        "key",
        "count",
        severity_weight(key).alias("weight"),
        confidence_factor(confidence).cast("double").alias("factor"),
        contribution(key, count, confidence).cast("double").alias("contribution"),
    )


def bonuses(spark, sf_dir):
    return (
        derive(spark, sf_dir, "types")
        .groupBy("types")
        .agg(F.count("*").alias("n"))
        .select(
            "types",
            cooccurrence_bonus(F.col("types")).alias("backend"),
            cooccurrence_bonus(F.col("types"), "browser").alias("browser"),
            "n",
        )
    )


def final_scores(spark, sf_dir):
    raw, types = F.col("raw_score"), F.col("types")
    return derive(spark, sf_dir, "raw_scores").select(
        "o_orderkey",
        *[
            final_score(raw, cooccurrence_bonus(types, p), p).alias(p)
            for p in ("backend", "browser")
        ],
    )


def levels(spark, sf_dir):
    return derive(spark, sf_dir, "whole_scores").select(
        "o_orderkey", "score", risk_level(F.col("score")).alias("risk_level")
    )


def tiers(spark, sf_dir):
    return derive(spark, sf_dir, "balances").select(
        "c_custkey", *[classify_tier(F.col("value"), p).alias(p) for p in ("backend", "browser")]
    )


def _score_findings(profile: str) -> Query:
    def query(spark, sf_dir):
        scored = score_findings(
            derive(spark, sf_dir, "line_findings"), ["l_orderkey"], profile=profile
        )
        return _doubles(scored, "raw_score")

    return query


def breakdown_findings(spark, sf_dir):
    findings = derive(spark, sf_dir, "line_findings").withColumn(
        "seq", F.struct("l_linenumber", "l_extendedprice", "l_quantity", "l_suppkey")
    )
    entries = breakdown_of(findings, ["l_orderkey"], last_by="seq")
    return _doubles(entries, "confidence_factor", "volume_multiplier", "contribution")


def score_legacy(spark, sf_dir):
    return legacy_score(_scored(spark, sf_dir, "derived")).select("doc_id", "score")


def _breakdown_sorted(profile: str) -> Query:
    def query(spark, sf_dir):
        entries = breakdown_table(_scored(spark, sf_dir, "derived", profile), ["doc_id"])
        return _doubles(entries, "confidence_factor", "volume_multiplier", "contribution")

    return query


def _recommendations(corpus: str, profile: str = "backend") -> Query:
    def query(spark, sf_dir):
        advised = with_recommendations(
            _scanned(spark, sf_dir, corpus, profile=profile, samples=False), profile=profile
        )
        return numbered_recommendations(advised, keys_of(corpus))

    return query


def _records(spark, sf_dir, corpus) -> DataFrame:
    named = texts(spark, sf_dir, corpus).select(
        F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("filename"), "text"
    )
    return report(named)


def report_record(spark, sf_dir):
    return _doubles(_records(spark, sf_dir, "derived"), "raw_score").select(
        "status",
        "filename",
        "size_bytes",
        "total_characters",
        "score",
        "risk_level",
        "total_findings",
        F.size("findings").alias("n_findings"),
        F.size("breakdown").alias("n_breakdown"),
        "cooccurrence_bonus",
        "raw_score",
        F.size("recommendations").alias("n_recommendations"),
    )


def report_json(spark, sf_dir):
    return as_json(scan_log(_records(spark, sf_dir, "derived")))


def scan_log_lines(spark, sf_dir):
    return _doubles(scan_log(_records(spark, sf_dir, "documents")), "raw_score")


def _uploads(spark, sf_dir) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 11 == 0, F.col("dotless")).otherwise(F.col("dotted"))
    return derive(spark, sf_dir, "uploads").select(
        "o_orderkey", name.alias("filename"), "size_bytes"
    )


def _gates(profile: str) -> Query:
    return lambda spark, sf_dir: gate(_uploads(spark, sf_dir), profile=profile)


def rejected(spark, sf_dir):
    return quarantine(gate(_uploads(spark, sf_dir)))


def _spoilt_reports(spark, sf_dir) -> DataFrame:
    """Reports of this engine, most of them spoilt in one field."""
    doc_id = F.regexp_extract("filename", "([0-9]+)", 1).cast("bigint")
    reports = _records(spark, sf_dir, "derived").withColumn("doc_id", doc_id)
    spoilt = lambda n, bad, column: F.when(F.col("doc_id") % 9 == n, bad).otherwise(F.col(column))
    minus = lambda x, field: x.withField(field, -x[field])
    return reports.withColumns({
        "score": spoilt(1, F.lit(101), "score"),
        "risk_level": spoilt(2, F.lit("SEVERE"), "risk_level"),
        "total_findings": spoilt(3, F.lit(-1), "total_findings"),
        "total_characters": spoilt(4, F.lit(None).cast("int"), "total_characters"),
        "cooccurrence_bonus": spoilt(5, F.lit(-5), "cooccurrence_bonus"),
        "size_bytes": spoilt(6, F.lit(-1).cast("bigint"), "size_bytes"),
        "findings": spoilt(7, F.transform("findings", lambda f: minus(f, "count")), "findings"),
        "breakdown": spoilt(8, F.transform_values("breakdown", lambda k, e: minus(e, "severity_weight")), "breakdown"),
    })


def own_report_violations(spark, sf_dir):
    """Against all eight checks."""
    return report_violations(_spoilt_reports(spark, sf_dir)).select("doc_id", "violation")


def report_metrics(spark, sf_dir):
    """The same counts, taken while the reports are written."""
    seen = write_checked(_spoilt_reports(spark, sf_dir), shared_folder(spark, "checked-reports"))
    return spark.createDataFrame(sorted(seen.items()), "metric string, n bigint")


def _exposure(corpus: str, *by: str) -> Query:
    return lambda spark, sf_dir: exposure_by(_scanned(spark, sf_dir, corpus, samples=False), *by)


def _levels(corpus: str, *by: str) -> Query:
    return lambda spark, sf_dir: documents_by_level(_scored(spark, sf_dir, corpus), *by)


def _top(corpus: str, k: int) -> Query:
    return lambda spark, sf_dir: top_risky(_scored(spark, sf_dir, corpus), k, ["doc_id"]).select(
        "doc_id", "score", "risk_level", "total_findings"
    )


def top_k_by_source(spark, sf_dir):
    ranked = top_risky_by(_scored(spark, sf_dir, "documents"), 5, ["source"], ["doc_id"])
    return ranked.select("source", "rank", "doc_id", "score", "risk_level")


def _cube(*fields: str) -> Query:
    def query(spark, sf_dir):
        scanned = _scanned(spark, sf_dir, "documents", samples=False)
        return exposure_cube(scanned, ["source", "lang"], fields)

    return query


SALT = "documents of this corpus"


def distinct_exposed(spark, sf_dir):
    """Different values exposed per rule, exactly."""
    hashes = value_hashes(texts(spark, sf_dir, "orders"), SALT)
    return hashes.groupBy("key").agg(F.countDistinct("value").alias("values"))


def distinct_estimates(spark, sf_dir):
    """The same by sketches of parts, merged, and whether each is within four standard errors."""
    docs = texts(spark, sf_dir, "orders").withColumn("part", F.col("doc_id") % 7)
    hashes = value_hashes(docs, SALT, ["part"])
    merged = merge_values(distinct_values(hashes, ["part", "key"]), ["key"]).select("key", F.col("values").alias("estimate"))
    both = distinct_exposed(spark, sf_dir).join(merged, "key")
    error = 4 * 1.04 / 2**6
    return both.select("key", "values", (F.abs(F.col("estimate") - F.col("values")) <= error * F.col("values") + 1).alias("near"))


def _binary_decode(profile: str) -> Query:
    """Texts as bytes in three encodings (marked UTF-8, UTF-8, Latin-1), decoded again."""

    def query(spark, sf_dir):
        text = F.col("text")
        latin1 = F.encode(F.regexp_replace(text, "[^\\x00-\\xff]", "?"), "ISO-8859-1")
        content = (
            F.when(F.col("doc_id") % 3 == 0, F.encode(F.concat(F.lit("\ufeff"), text), "UTF-8"))
            .when(F.col("doc_id") % 3 == 1, F.encode(text, "UTF-8"))
            .otherwise(latin1)
        )
        decoded = texts(spark, sf_dir, "documents").select(
            "doc_id", decode_text(content, profile).alias("decoded")
        )
        return decoded.select(
            "doc_id", F.md5("decoded").alias("text_md5"), F.length("decoded").alias("chars")
        )

    return query


def _files(df: DataFrame, with_extracted: bool = False) -> DataFrame:
    """Documents as files of several kinds, in UTF-8 with and without a mark and in Latin-1.

    ``with_extracted`` adds the text of those kinds that need a parser, as one would hand it over.
    """
    text = F.coalesce("text", F.lit(""))
    kind = F.element_at(F.array(*[F.lit(e) for e in FILE_KINDS]), (F.col("doc_id") % len(FILE_KINDS) + 1).cast("int"))
    latin1 = F.encode(F.regexp_replace(text, "[^\\x00-\\xff]", "?"), "ISO-8859-1")
    content = (
        F.when(F.col("doc_id") % 3 == 0, F.encode(F.concat(F.lit("\ufeff"), text), "UTF-8"))
        .when(F.col("doc_id") % 3 == 1, F.encode(text, "UTF-8"))
        .otherwise(latin1)
    )
    parsed = [F.when(kind.isin(".pdf", ".Docx"), text).alias("extracted")] if with_extracted else []
    files = df.select(
        *parsed, "doc_id", "source", F.concat(F.col("doc_id").cast("string"), kind).alias("filename"), content.alias("content")
    )
    return files.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def _masked(corpus: str) -> Query:
    """Masked texts, told by their digest, and where the matches were."""

    def query(spark, sf_dir):
        masked = mask(texts(spark, sf_dir, corpus))
        place = lambda p: F.concat_ws(":", p["key"], p["start"], p["end"])
        return masked.select(
            *keys_of(corpus),
            F.size("masked").alias("n_masked"),
            F.md5("masked_text").alias("masked_md5"),
            F.array_join(F.transform("masked", place), ",").alias("places"),
        )

    return query


def assess_uploads(spark, sf_dir):
    """Files of every kind and size through the gates, then scored: what was not read has no score."""
    read = extract_text(_files(texts(spark, sf_dir, "documents")), max_bytes=UPLOAD_CAP)
    scored = assess(read, keep=["doc_id", "filename", "status", "http_code"])
    return _doubles(flat_report(scored, ["doc_id", "filename", "status", "http_code"]), "raw_score")


def levels_uploads(spark, sf_dir):
    read = extract_text(_files(texts(spark, sf_dir, "documents")), max_bytes=UPLOAD_CAP)
    return documents_by_level(with_risk(scan(read, keep=["source"], samples=False)), "source")


_SQL_CALLS = """
    SELECT o_orderkey, {p}luhn_valid(card) AS luhn, {p}verhoeff_valid(identity) AS verhoeff, {p}pan_valid(code) AS pan,
      {p}redact(code) AS redacted, {p}format_bytes(size_bytes) AS shown, {p}rule_label(key) AS label,
      cast({p}contribution(key, n, confidence) AS double) AS contribution,
      {p}final_score(raw_score, {p}cooccurrence_bonus(types)) AS final, {p}risk_level(score) AS risk_level,
      {p}classify_tier(score * 1.01D) AS tier
    FROM {{orders}}"""


def _sql_functions(profile: str) -> Query:
    """What users of SQL write, over values made from every order."""

    def query(spark, sf_dir):
        prefix = f"leaksieve_{profile}_"
        register_functions(spark, profile, prefix)
        return spark.sql(_SQL_CALLS.format(p=prefix), orders=derive(spark, sf_dir, "sql_values"))

    return query


def file_scan(spark, sf_dir):
    """Every document as a file of its own, whatever its kind and size: decoded, scanned by all rules, totals per source."""
    files = _files(texts(spark, sf_dir, "documents"), with_extracted=True)
    read = extract_text(files, any_extension=True, max_bytes=None)
    scanned = scan(read.select("source", (F.col("status") == "ok").alias("was_read"), "text"), samples=False)
    matches = F.aggregate("findings", F.lit(0), lambda n, f: n + f["count"])
    return scanned.groupBy("source", "was_read").agg(
        F.count("*").alias("files"), F.sum("total_characters").alias("characters"), F.sum(matches).alias("matches")
    )


def any_extension(spark, sf_dir):
    """Files of any kind, decoded as well as possible."""
    files = _files(texts(spark, sf_dir, "documents"), with_extracted=True)
    read = extract_text(files, any_extension=True, max_bytes=None)
    return read.select("doc_id", "filename", "status", "http_code", F.md5("text").alias("text_md5"))


def _upload_reports(files: DataFrame) -> DataFrame:
    return _upload_columns(report(extract_text(files, max_bytes=UPLOAD_CAP), size_bytes="size_bytes", keep=["doc_id"]))


def _upload_columns(reports: DataFrame) -> DataFrame:
    return _doubles(reports, "raw_score").select(
        "doc_id", "status", "filename", "size_bytes", "total_characters", "score", "risk_level", "total_findings",
        F.when(F.col("findings").isNotNull(), F.size("findings")).alias("types"), "raw_score",
    )


def report_uploads(spark, sf_dir):
    """Files of every kind and size: reports of what was read, errors for the rest."""
    return _upload_reports(_files(texts(spark, sf_dir, "documents")))


def report_json_full(spark, sf_dir):
    """The whole record as JSON: findings with samples, breakdown and recommendations."""
    return as_json(_records(spark, sf_dir, "derived"))


def _saved(files: DataFrame, folder: str) -> None:
    save_files(files.select(F.concat_ws("/", "source", "filename").alias("path"), "content"), folder)


def _loaded_reports(loaded: DataFrame) -> DataFrame:
    """Reports of the files of a folder, by the number in their names."""
    doc_id = F.regexp_extract("filename", "^([0-9]+)", 1).cast("bigint")
    return _upload_reports(loaded.withColumn("doc_id", doc_id))


def folder_scan(spark, sf_dir):
    """Every document as a real file: written, listed, loaded and reported."""
    folder = shared_folder(spark, "folder")
    _saved(_files(texts(spark, sf_dir, "documents")), folder)
    return _loaded_reports(load_files(list_files(spark, folder), partitions=2 * spark.sparkContext.defaultParallelism))


def folder_update(spark, sf_dir):
    """A folder scanned twice; between the runs half the files come in and some change."""
    folder, state = shared_folder(spark, "folder"), shared_folder(spark, "folder-state")
    files = _files(texts(spark, sf_dir, "documents"))
    older = F.when(F.col("doc_id") % 10 == 0, F.encode(F.lit("an older version, pwd=12345678"), "UTF-8")).otherwise(F.col("content"))
    _saved(files.where("doc_id % 2 = 0").withColumn("content", older), folder)

    def run() -> None:
        with_path = lambda loaded: extract_text(loaded, max_bytes=UPLOAD_CAP)
        update(spark, folder, state, lambda loaded: report(with_path(loaded), size_bytes="size_bytes", keep=["path"]))

    run()
    _saved(files.where("doc_id % 2 = 1 or doc_id % 10 = 0"), folder)
    run()
    latest = current(spark, folder, state)
    doc_id = F.regexp_extract("filename", "^([0-9]+)", 1).cast("bigint")
    return _upload_columns(latest.withColumn("doc_id", doc_id))


def _arriving_files(spark, sf_dir) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    arriving = read_stream(spark, f"{sf_dir}/{{documents}}.parquet", schema).select("doc_id", "source", "text")
    return _files(spread(arriving, 2 * spark.sparkContext.defaultParallelism))


def _worked_off(results: DataFrame, name: str) -> DataFrame:
    spark = results.sparkSession
    folder = shared_folder(spark, name)
    start_scan(results, f"{folder}/rows", f"{folder}/checkpoint", until_done=True).awaitTermination()
    return spark.read.schema(results.schema).parquet(f"{folder}/rows")


def stream_reports(spark, sf_dir):
    """Arriving files gated, decoded and reported by a stream."""
    return _worked_off(_upload_reports(_arriving_files(spark, sf_dir)), "stream-reports")


def stream_quarantine(spark, sf_dir):
    """The error records of the same stream."""
    return _worked_off(quarantine(extract_text(_arriving_files(spark, sf_dir), max_bytes=UPLOAD_CAP)), "stream-quarantine")


def stream_scan(spark, sf_dir):
    """The document reports, produced by a stream that works off the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    folder = shared_folder(spark, "stream")
    # a pattern serves a table kept as one file as well as one kept as a folder
    arriving = read_stream(spark, f"{sf_dir}/{{documents}}.parquet", schema).select(*TABLES["documents"][2], "text")
    arriving = spread(arriving, 2 * spark.sparkContext.defaultParallelism)
    results = flat_report(assess(arriving), keys_of("documents"))
    start_scan(results, f"{folder}/reports", f"{folder}/checkpoint", until_done=True).awaitTermination()
    return spark.read.schema(results.schema).parquet(f"{folder}/reports")


def _both_kinds(spark, sf_dir) -> DataFrame:
    """Reports and errors that one stream wrote in one pass; its one batch is then written again."""
    files = extract_text(_arriving_files(spark, sf_dir), max_bytes=UPLOAD_CAP)
    results = report_stream(files, keep=["doc_id"])
    folder = shared_folder(spark, "stream-both")
    for attempt in ("first", "again"):  # without the checkpoint of the first, all batches are replayed
        start_batches(results, f"{folder}/rows", f"{folder}/{attempt}", ["status"], until_done=True).awaitTermination()
    return read_batches(spark, f"{folder}/rows", results.schema)


def stream_sinks_reports(spark, sf_dir):
    return _upload_columns(_both_kinds(spark, sf_dir))


def stream_sinks_errors(spark, sf_dir):
    return quarantine(_both_kinds(spark, sf_dir))


def stream_once(spark, sf_dir):
    """Every document delivered twice, minutes apart; reported once. The stream is stopped in between.

    A delivery is worked off in batches of up to 1,000 files, not file by file: each batch writes
    the state of every partition, whatever the number of its rows.
    """
    folder, out = shared_folder(spark, "stream-once"), shared_folder(spark, "stream-once-out")
    docs = texts(spark, sf_dir, "documents")
    arrived = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 3600)
    for minutes in (0, 5):
        again = docs.withColumn("arrived", arrived + F.make_dt_interval(mins=F.lit(minutes)))
        again.write.mode("append").parquet(f"{folder}/in")
        single = once(read_stream(spark, f"{folder}/in", again.schema), ["doc_id"], "arrived", "2 hours")
        results = flat_report(assess(single, keep=list(keys_of("documents"))), keys_of("documents"))
        start_scan(results, f"{out}/rows", f"{out}/checkpoint", until_done=True).awaitTermination()
    return spark.read.schema(results.schema).parquet(f"{out}/rows")


def _stream_rollup(rollup: Callable[[DataFrame], DataFrame], by: tuple[str, ...], scored: bool) -> Query:
    """A roll-up kept up to date by a stream that is stopped and started again in between.

    Each half is written by as many tasks as the table is read by.
    """

    def query(spark, sf_dir):
        folder = shared_folder(spark, "stream-rollup")
        docs = texts(spark, sf_dir, "documents")
        for part in (0, 1):
            docs.where(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
            arriving = spread(read_stream(spark, f"{folder}/in", docs.schema), 2 * spark.sparkContext.defaultParallelism)
            scanned = scan(arriving, keep=["source"], samples=False)
            results = rollup(with_risk(scanned) if scored else scanned)
            start_batches(results, f"{folder}/out", f"{folder}/checkpoint", mode="update", until_done=True).awaitTermination()
        return latest_groups(spark, f"{folder}/out", results.schema, by)

    return query


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for corpus in ("documents", "derived", "pages", "conversations", "benchmark"):
        out[f"report_{corpus}"] = _flat(corpus)
    for corpus in ("documents", "derived", "pages"):
        out[f"report_{corpus}_browser"] = _flat(corpus, "browser")
    for key in rule_keys():
        out[f"detect_{key}"] = _detect(key)
    for corpus in ("documents", "pages"):
        out[f"detect_all_{corpus}"] = _detect_all(corpus)
    out.update(
        findings_long=findings_long,
        findings_order_backend=_findings_order("backend"),
        findings_order_browser=_findings_order("browser"),
        samples=_samples("documents"),
        samples_derived=_samples("derived"),
        samples_distinct=_samples("orders"),
        findings_distinct=_flat("orders"),
        sensitive_flag=sensitive_flag,
        text_length_browser=text_length_browser,
        secrets_only=secrets_only,
        custom_rule=custom_rule,
        recommendations_custom=recommendations_custom,
        rule_catalog=rule_catalog_usage,
        coverage=coverage_usage,
        luhn=luhn,
        verhoeff=verhoeff,
        pan_valid=pan_structure,
        redact=redacted,
        format_bytes=human_sizes,
        rule_label=labels,
        file_extension=extensions,
        volume_multiplier=volumes,
        contribution=contributions,
        bonus=bonuses,
        final_score=final_scores,
        risk_level=levels,
        classify_tier=tiers,
        score_findings=_score_findings("backend"),
        score_findings_browser=_score_findings("browser"),
        breakdown_findings=breakdown_findings,
        score_legacy=score_legacy,
        breakdown_sorted=_breakdown_sorted("backend"),
        breakdown_sorted_browser=_breakdown_sorted("browser"),
        recommendations_long=_recommendations("derived"),
        recommendations_long_browser=_recommendations("derived", "browser"),
        recommendations_documents=_recommendations("documents"),
        report_record=report_record,
        report_json=report_json,
        report_json_full=report_json_full,
        report_uploads=report_uploads,
        any_extension=any_extension,
        scan_log=scan_log_lines,
        gates=_gates("backend"),
        gates_browser=_gates("browser"),
        quarantine=rejected,
        request_violations=lambda spark, sf_dir: request_violations(derive(spark, sf_dir, "requests")),
        report_violations=lambda spark, sf_dir: report_violations(
            derive(spark, sf_dir, "foreign_reports")
        ),
        own_report_violations=own_report_violations,
        exposure_by_rule=_exposure("documents", "key"),
        exposure_by_rule_derived=_exposure("derived", "key"),
        exposure_by_source=_exposure("documents", "source", "category"),
        exposure_by_lang=_exposure("documents", "lang", "severity"),
        exposure_by_source_only=_exposure("documents", "source"),
        docs_by_level=_levels("documents"),
        docs_by_level_derived=_levels("derived"),
        docs_by_level_source=_levels("documents", "source"),
        top_k_risky=_top("documents", 20),
        top_k_risky_derived=_top("derived", 50),
        binary_decode=_binary_decode("backend"),
        binary_decode_browser=_binary_decode("browser"),
        masked_text=_masked("documents"),
        masked_text_derived=_masked("derived"),
        masked_text_orders=_masked("orders"),
        assess_uploads=assess_uploads,
        levels_uploads=levels_uploads,
        sql_functions=_sql_functions("backend"),
        sql_functions_browser=_sql_functions("browser"),
        top_k_by_source=top_k_by_source,
        exposure_cube=_cube("category"),
        exposure_cube_two=_cube("category", "severity"),
        distinct_exposed=distinct_exposed,
        distinct_estimates=distinct_estimates,
        report_metrics=report_metrics,
        folder_scan=folder_scan,
        folder_update=folder_update,
        stream_sinks_reports=stream_sinks_reports,
        stream_sinks_errors=stream_sinks_errors,
        stream_once=stream_once,
        stream_exposure=_stream_rollup(lambda s: exposure_by(s, "source", "category"), ("source", "category"), False),
        stream_levels=_stream_rollup(lambda s: documents_by_level(s, "source"), ("source", "risk_level"), True),
        file_scan=file_scan,
        stream_scan=stream_scan,
        stream_reports=stream_reports,
        stream_quarantine=stream_quarantine,
    )
    return out
