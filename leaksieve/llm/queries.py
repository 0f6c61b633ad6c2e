"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    conversations,
    decontaminate,
    fingerprint,
    langid,
    pii,
    quality_rules,
    secrets,
    simhash,
    substring_dedup,
    suffix_dedup,
    url_filter,
    whitening,
)
from .common import ship
from .oracle import oracle_sql  # noqa: F401


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal(suffix_dedup.repeated_bytes(_docs(spark, sf_dir)))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(_docs(spark, sf_dir), path, public_tokenizers.PATTERN)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(_docs(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = pii.personal_data(docs, pii.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"),
        pii.span_list(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.benchmark_hits(_docs(spark, sf_dir), benchmark)
    return decontaminate.contamination(hits).drop("spans")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal(substring_dedup.repeated_words(_docs(spark, sf_dir)))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = secrets.secret_spans(docs, rare=secrets.letters(docs))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
    )


URL_RULES = (
    ("net/", url_filter.BLOCK),
    ("example.net/en/", url_filter.ALLOW),
    ("example.com/de/", url_filter.BLOCK),
    ("org/fr/", url_filter.ALLOW),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = url_filter.train(url_filter.label(pages, URL_RULES))
    return url_filter.judge(pages, URL_RULES, model).drop("score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(_docs(spark, sf_dir), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return conversations.repair(conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    done = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return done.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def queries() -> dict:
    own = [
        op1_suffix_dedup, op2_byte_bpe, op3_fingerprint, op4_pii, op5_decontaminate,
        op6_substring_dedup, op7_secrets, op8_url_filter, op9_language, op10_simhash,
        op11_quality_rules, op12_conversation_repair, op13_whitening,
    ]
    return {f.__name__: f for f in own}
