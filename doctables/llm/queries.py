"""One query per operator over its whole table, with production parameters, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doctables.llm import bisectors, filter_audit, hamming, line_rules, oracles, packing, repeats, secrets, sentencepieces, spaced_seeds, toxicity, transducer, wavelet, weak_labels
from doctables.llm.tokens import tokenizer_path
from doctables.sinks.stored import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wavelet.wavelet_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return wavelet.digests(files)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.verdicts(table(spark, sf_dir, "documents")).drop("tie", "removed")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op4_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.near_duplicates(table(spark, sf_dir, "documents"))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tie")


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents"), shared_folder(spark)))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents")).drop("removed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.scored(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    return sentencepieces.digests(sentencepieces.decoded(sentencepieces.encoded(table(spark, sf_dir, "documents"), model), model))


def op12_bisector_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisectors.clustered(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_wavelet_files, op2_line_rules, op3_packing, op4_hamming_join, op5_spaced_seeds, op6_secret_ledger, op7_repeats, op8_toxicity, op9_weak_labels, op10_token_counts,
    op11_sentencepieces, op12_bisector_tournament, op13_filter_audit,
)}
#: The others tokenize, walk automata or fit models; tests/llm holds them against plain versions.
ORACLES = {"op2_line_rules": oracles.LINE_RULES, "op4_hamming_join": oracles.NEAR_DUPLICATES, "op7_repeats": oracles.REPEATS, "op12_bisector_tournament": oracles.CENTROIDS, "op13_filter_audit": oracles.FILTER_AUDIT}
