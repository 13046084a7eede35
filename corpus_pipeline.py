"""A corpus pipeline of five stages over ``documents``: language, lines, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the last adds the ids.
The driver of the pipeline writes every stage's result as Parquet and reads it again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm import decontamination, jaccard, language, lines, pieces
from almagest.llm.blocks import ROW, numbered, written
from almagest.llm.queries import PIECE_MODEL, table

#: A text of ``FULL_GRAMS`` unlike n-grams or more whose cosine with every profile is less than this is in none of the languages.  The cosine of clean
#: texts grows with the root of that number, and so does the least one asked of shorter texts: 0.2 at 300, which is some 50 words.
LEAST_COSINE = 0.25
FULL_GRAMS = 470


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no letters, no text, or letters no more like any learned profile than noise of their length."""
    labels, prototypes = language.learn(docs)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name can clash with the result's
    found = language.predict(plain, labels, prototypes, text_col=f"c{docs.columns.index('text')}", keep=plain.columns)
    least = LEAST_COSINE * F.sqrt(F.least(F.col("n_unlike") / FULL_GRAMS, F.lit(1.0)))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select(*plain.columns).toDF(*docs.columns)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, exact copies however short they are; so do documents of which nothing but blank lines is left, unless nothing was removed.

    Only id and text go through the operator; the other columns, whatever their names and types, are joined on again by row.
    """
    rows = numbered(docs, "rows")
    found = lines.remove_repeated_lines(rows.select("doc_id", "text", ROW), carry=[ROW]).select(F.col(ROW).alias("_of"), "n_removed", "kept_text")
    left = found.filter((F.col("n_removed") == 0) | F.rlike("kept_text", F.lit(r"[^\x20\x09-\x0D]")) | F.col("kept_text").isNull())
    values = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    others = rows.select(ROW, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in values]).alias("_rest"))
    joined = left.join(others, F.col("_of") == F.col(ROW))
    return joined.select(*[(values[c].cast(docs.schema[c].dataType) if c in values else F.col("_rest")[c]).alias(c) for c in docs.columns])


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the least id (null ids come last); rows are told apart whatever their ids."""
    rows = numbered(docs, "rows")
    found = jaccard.near_duplicate_classes(rows, 5, 80, id_col=ROW)
    least = found.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)).alias("least"))
    return rows.join(least.select(F.col(f"least.{ROW}").alias(ROW)), ROW, "left_semi").select(*docs.columns)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows, re-parameterised or not, go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, and whether decoding gives the text again."""
    return pieces.encoded(docs, PIECE_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", stage_language),
    ("lines", stage_lines),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("tokens", stage_tokens),
]

#: Learned profiles and the Viterbi search have no SQL; each stage is tested against a brute-force version of it, on what its predecessor kept.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
