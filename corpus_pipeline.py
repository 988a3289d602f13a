"""The corpus pipeline: stages over documents, each on all that the one before kept.

Rules reject low quality; one document of each near-duplicate class stays;
documents that leak benchmark items go; secrets are cut out of texts; what is
left is encoded. ``run`` gives a row for each document left: ``doc_id``,
``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit integers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airrline.llm import bpe, decontaminate, near_dup, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.keep(quality.judge(packed, rules)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out_col="__leaks")
    return found.filter(F.size("__leaks") == 0).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; ``n_chars`` follows."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = secrets.find_secrets(docs, with_text=True, carry=rest, out_cols=("__spans", "__text"))
    found = found.withColumnRenamed("__text", "text")
    changed = F.when(F.size("__spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", changed).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers as tokenizers

    return bpe.encode(docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, with_decoded=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("byte-level BPE", encoding),
]

ORACLE_SQL = None  # rules are learned and the other stages are no SQL; tests hold each against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
