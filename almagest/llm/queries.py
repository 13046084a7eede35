"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm import oracles

#: A public vocabulary file outside the repository; ALMAGEST_PIECE_MODEL names another.
PIECE_MODEL = os.environ.get("ALMAGEST_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compact(df: DataFrame) -> DataFrame:
    """Small rows from many tasks, evenly dealt to few files."""
    return df.hint("rebalance")


#: verdict, host, path
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm.urls import judge

    return compact(judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"), URL_RULES))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm.jaccard import near_duplicate_classes

    return compact(near_duplicate_classes(table(spark, sf_dir, "documents"), 3, 90))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm.suffixes import remove_repeated_bytes

    out = remove_repeated_bytes(table(spark, sf_dir, "documents"), 400)
    return compact(out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm.secrets import BASE, scan, written_out

    found = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = written_out(F.filter("found", lambda s: s["place"] < len(BASE)))
    return compact(found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), written_out(F.col("found")).alias("spans")))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm import media

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), media.payload(F.col("text")).alias("payload"))
    pages = docs.select("doc_id", media.as_page(F.col("text"), F.sha2("payload", 256)).alias("html"))
    refs = media.references(media.sequences(pages, "doc_id", "html"))
    found = media.resolved(refs, media.stored_media(docs))
    return compact(found.select(F.col("id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm.lines import remove_repeated_lines

    return remove_repeated_lines(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm import language

    docs = table(spark, sf_dir, "documents")
    labels, prototypes = language.learn(docs.filter(~language.held_out()))
    found = language.predict(docs, labels, prototypes)
    return compact(found.select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm.decontamination import judged

    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return compact(out.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ",")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm.pieces import encoded

    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_MODEL)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from almagest.llm.repeats import remove_repeated_windows

    out = remove_repeated_windows(table(spark, sf_dir, "documents"), 20)
    return compact(out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_media_columns": op5_media_columns,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_substring_dedup": op10_substring_dedup,
}

#: Suffix arrays, media features, learned models and the Viterbi search have no SQL; tests hold them against brute force, round trips and held-out rows.
ORACLES: dict[str, str] = {
    "op1_url_filters": oracles.url_sql(URL_RULES),
    "op2_ngram_jaccard_join": oracles.jaccard_sql(3, 90),
    "op4_secret_scans": oracles.secrets_sql(),
    "op6_line_dedup": oracles.lines_sql(1, 5),
    "op8_benchmark_decontamination": oracles.contamination_sql(),
    "op10_substring_dedup": oracles.repeats_sql(20),
}
