"""Filtering and mixing stages of a corpus pipeline: (spark, docs, sf_dir) -> documents.

Every stage decides with its operator over all rows it is given, and keeps the
rows' own columns whatever their names.  Rows are told apart by their file and
their place in it (see :func:`korral.llm._kernel.uid`), which no split of a scan
changes, so rows that repeat a doc_id are decided one by one.  Documents that
aren't Parquet files are checkpointed first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korral.llm import _kernel as K
from korral.llm import toxicity
from korral.llm.decontaminate import decontaminate
from korral.llm.exact_dedup import exact_dedup
from korral.llm.mixing import mix
from korral.llm.ngram_join import ngram_join


#: A list of rows that go is broadcast up to this length (16 bytes a row); a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose uid is not in ``gone``: the short list of what goes is joined, not of what stays."""
    gone = K.cut(gone.select("uid"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)  # so the texts needn't move
    row = docs.select(F.struct("*").alias("row"), K.uid(docs).alias("uid"))
    return row.join(gone, "uid", "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model of the labels."""
    docs = K.fixed(docs)
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _without(docs, scored.where(F.col("score") >= toxicity.THRESHOLD))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    docs = K.fixed(docs)
    return _without(docs, exact_dedup(docs).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join, the one with the smallest doc_id (null last); documents without words stay."""
    docs = K.fixed(docs)
    found = ngram_join(docs)
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("f"))
    kept = first.select(F.col("f.uid").alias("uid"))
    return _without(docs, found.where("n_shingles > 0").join(kept, "uid", "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    docs = K.fixed(docs)
    return _without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with all their columns and copies, taken, size, source_size, target (after ``mix_`` where the documents have such a column)."""
    docs = K.fixed(docs)
    taken = K.cut(mix(docs).where("copies > 0").select("uid", "copies", "taken", "size", "source_size", "target"))
    names = {c: f"mix_{c}" if c in {x.lower() for x in docs.columns} else c for c in taken.columns[1:]}
    if taken.count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)  # so the texts needn't move
    row = docs.select(F.struct("*").alias("row"), K.uid(docs).alias("uid")).join(taken, "uid")
    return row.select("row.*", *(F.col(c).alias(n) for c, n in names.items()))
