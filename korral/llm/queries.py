"""The contract queries of the ten operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korral.llm import html_extract, language_id, quality, toxicity
from korral.llm.decontaminate import decontaminate
from korral.llm.exact_dedup import exact_dedup
from korral.llm.learning import held_out
from korral.llm.license_scan import scan_licenses
from korral.llm.line_dedup import line_dedup
from korral.llm.mixing import mix
from korral.llm.ngram_join import ngram_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", quality.FOLDS, quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.train(docs))
    return out.select("doc_id", held_out("doc_id", language_id.FOLDS, language_id.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places").withColumn("score", F.round("score", 9))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_sentences", F.size("offending").cast("bigint").alias("n_offending"),
                      F.array_join(F.transform("offending", lambda o: F.concat(o["start"].cast("string"), F.lit("-"), o["end"].cast("string"))), ",").alias("offending"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1,
    "op2_line_dedup": op2,
    "op3_quality_classifier": op3,
    "op4_language_id": op4,
    "op5_html_extraction": op5,
    "op6_source_mixing": op6,
    "op7_license_scan": op7,
    "op8_ngram_jaccard_join": op8,
    "op9_toxicity": op9,
    "op10_decontamination": op10,
}
