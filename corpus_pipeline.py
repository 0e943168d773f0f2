"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, secrets, packing.

Each stage works on all that the stage before kept. Its result is written as Parquet to the cluster's shared folder and read again, so a
lost executor costs only its own tasks, and no stage is computed twice. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.llm import hamming, line_rules, packing, secrets, spaced_seeds
from doctables.llm.tokens import tokenizer_path
from doctables.sinks.stored import shared_folder, stored

NEAR_WORDS, NEAR_PERCENT = 5, 80


def sized(docs: DataFrame) -> DataFrame:
    """The documents with n_chars as their texts now are, if they have that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that too many documents of a host share are cut out of the others."""
    return sized(line_rules.cleaned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. An id is one document: all rows of that id stay or go."""
    gone = hamming.near_duplicates(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).filter("not kept").select("doc_id").distinct()
    other = F.col("d.doc_id").cast("long") == F.col("g.doc_id")
    return docs.alias("d").join(gone.alias("g"), other, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return spaced_seeds.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; no document goes."""
    return sized(secrets.redacted(docs, shared_folder(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row per piece."""
    return packing.piece_digests(packing.packed(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]
#: Tokenizing and hashing are not SQL; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
