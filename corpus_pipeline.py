"""A training-data pipeline over ``documents``: five stages, each one an operator of ``leaksieve.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm import bpe, decontaminate, langid, secrets, simhash
from leaksieve.llm.common import ship, written

#: Language identification and byte-level BPE are no SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those without one (no text, no letter) go.

    The model learns from the stage's own input.
    """
    docs = _given(spark, docs, sf_dir)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return _without(docs, langid.identify(docs, model, tagged=True).where(F.col("lang_pred") == langid.UNDETERMINED))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the first by doc_id, then by the hash of the text.

    Rows without a doc_id come last. Of rows alike in both the one with the least hash over all
    columns stays, so running a task again changes nothing.
    """
    docs = _given(spark, docs, sf_dir)
    id_, row = (c + "_" * max(map(len, docs.columns)) for c in ("_id", "_row"))
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    digest = F.xxhash64(rest, "text")
    first = simhash.first_rows(docs, digest)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    kept = written(first.select(key.alias(id_), F.col("row").alias(row)), "pipeline-first-rows")
    # rows alike in every column are one before they meet, so a group of them is no burden
    once = docs.withColumn(id_, key).withColumn(row, digest).dropDuplicates([id_, row])
    return once.join(kept, [id_, row], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, or with less than a twentieth of their words in them."""
    docs = _given(spark, docs, sf_dir)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate.benchmark_hits(docs, benchmark, tagged=True)
    return _without(docs, decontaminate.contamination(hits).where("contaminated"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mask; ``n_chars`` follows the text."""
    docs = _given(spark, docs, sf_dir)
    columns = docs.columns
    name = "_spans" + "_" * max(map(len, columns))
    found = secrets.secret_spans(docs, keep=[c for c in columns if c not in ("doc_id", "text")], name=name, rare=secrets.letters(docs))
    done = found.withColumn("text", secrets.masked(F.col("text"), F.col(name)))
    if "n_chars" in columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(F.size(name) > 0, length).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: how many, and the digests of the ids and of their decoding."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_digests(_given(spark, docs, sf_dir), path, public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("tokens", tokens),
]


def _given(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows that are not among the rejected, by doc_id (none too) and ``tag``, the hash of the text."""
    gone = rejected.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_tag"])
    return docs.join(gone, same, "left_anti")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = _given(spark, None, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
