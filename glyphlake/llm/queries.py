"""The queries over the training-data tables, one opN_ entry for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .ann import nearest_neighbours
from .jaccard_join import ngram_jaccard_join
from .language_id import identify_language, train_language_model
from .packing import pack_documents
from .quality_classifier import score_quality, train_quality_model
from .quality_rules import quality_rules
from .secrets import secret_scan
from .sentencepiece_codec import sentencepiece_encode
from .substring_dedup import substring_dedup
from .url_filter import Rule, url_filter

# The rules of op1.
URL_RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("block", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, URL_RULES).drop("url")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return out.select("doc_id", *(f"pieces.{p}{c}" for p in ("", "bpe_") for c in ("n_ids", "ids_crc32", "round_trip")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs, fold_of("doc_id", 3) != 1)
    out = identify_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (F.coalesce(fold_of("doc_id", 3), F.lit(1)) == 1).alias("held_out"), "language.lang_pred", "language.score")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality_model(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 4) != 2)
    out = score_quality(docs, model)
    return out.select("doc_id", (F.coalesce(fold_of("doc_id", 4), F.lit(2)) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_fraction", "longest_repeat")))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def base_spans(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", *(f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256")))


def base_counts(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *(f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return base_spans(secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return base_counts(quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = {name: f for name, f in globals().items() if name.startswith("op")}
    return numbered | {"secret_base_spans": secret_base_spans, "quality_base_counts": quality_base_counts}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": oracles.URL_FILTER,
        "op4_ngram_jaccard_join": oracles.JACCARD,
        "op10_substring_dedup": oracles.SUBSTRING_DEDUP,
        "secret_base_spans": oracles.SECRET_BASE,
        "quality_base_counts": oracles.QUALITY_BASE,
    }
