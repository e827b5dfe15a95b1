"""From graded samples to comparable per-problem counts.

Samples stay long: (model_key, dataset_key, problem_idx, sample_idx, ...).  One
shuffle by the problem key serves the truncation window and the counts; what
leaves is a row per model and problem, and everything after works on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("model_key", "dataset_key", "problem_idx")


def require_no_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """The rows, failing on the first null in a column: a missing grade must never count as wrong (or right)."""
    for c in columns:
        if c not in df.columns:
            raise KeyError(f"no column {c!r}; graded columns: {[x for x in df.columns if x.startswith('correct')]}")
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)))
    return df


def pick_models(df: DataFrame, models: list[str]) -> DataFrame:
    """The requested models' rows, filtered before any axis is derived; a model without rows is an error."""
    out = df.where(F.col("model_key").isin(models))
    present = {r.model_key for r in out.select("model_key").distinct().collect()}
    if missing := sorted(set(models) - present):
        raise ValueError(f"no graded rows for {missing}")
    return out


def missing_models(df: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.join(df.select("model_key").distinct(), "model_key", "left_anti")


def impure_arms(df: DataFrame) -> DataFrame:
    """(model, dataset) arms that mix prompt variants or sampling settings."""
    kinds = [F.count_distinct(c).alias(f"n_{c}") for c in ("variant", "sampling_id") if c in df.columns]
    out = df.groupBy("model_key", "dataset_key").agg(*kinds)
    return out.where(" or ".join(f"{c} > 1" for c in out.columns[2:]) or "false")


def group_sizes(df: DataFrame) -> DataFrame:
    """Distinct samples of each model and problem."""
    return df.groupBy(*KEY).agg(F.count_distinct("sample_idx").alias("n_raw"))


def ragged_arms(df: DataFrame) -> DataFrame:
    """Arms whose problems don't all have as many samples: n_min, n_max."""
    out = group_sizes(df).groupBy("model_key", "dataset_key").agg(F.min("n_raw").alias("n_min"), F.max("n_raw").alias("n_max"))
    return out.withColumn("ragged", F.col("n_min") < F.col("n_max"))


def truncated(df: DataFrame, strict: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """The first n samples by sample_idx of each model and problem, with n the least that any has.

    ``strict``: differing counts within an arm are an error; across arms the smaller count holds.
    ``sizes``: ``group_sizes(df)`` if they can be had without shuffling the samples.
    """
    by = W.partitionBy(*KEY).orderBy("sample_idx")
    ranked = df.withColumns({"rank_": F.row_number().over(by), "no_": F.dense_rank().over(by)})
    if strict and (bad := ragged_arms(df).where("ragged").limit(3).collect()):
        raise ValueError(f"ragged arms: {[(r.model_key, r.dataset_key, r.n_min, r.n_max) for r in bad]}")
    # A key's distinct samples are its last dense rank: no second shuffle of the samples.
    least = sizes.withColumnRenamed("n_raw", "n") if sizes is not None else ranked.groupBy(*KEY).agg(F.max("no_").alias("n"))
    least = least.agg(F.min("n").cast("bigint").alias("n"))  # one row
    return ranked.join(F.broadcast(least), F.col("rank_") <= F.col("n")).drop("rank_", "no_")


def dense_counts(df: DataFrame, correct: Column) -> DataFrame:
    """c of every model with every problem that any model has: a problem without rows counts as all wrong."""
    counts = df.groupBy(*KEY).agg(F.count_if(correct).alias("c"), F.first("n").alias("n"))
    own = F.map_from_entries(F.collect_list(F.struct("model_key", "c"))).alias("own")
    problems = counts.groupBy("dataset_key", "problem_idx").agg(own, F.max("n").alias("own_n"))  # an entry per model
    facts = problems.select(F.explode(F.map_keys("own")).alias("m"), "own_n").agg(F.array_sort(F.collect_set("m")).alias("models"), F.max("own_n").alias("n"))  # one row
    # n is never less than own_n: named so that both sides need the same columns of the samples, and their shuffle is reused.
    n = F.greatest("n", "own_n").alias("n")
    each = problems.crossJoin(F.broadcast(facts)).select(F.explode("models").alias("model_key"), "dataset_key", "problem_idx", "own", n)
    return each.select(*KEY, F.coalesce(F.try_element_at("own", F.col("model_key")), F.lit(0)).cast("bigint").alias("c"), "n")


def absent_problems(df: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.join(df.select("dataset_key", "problem_idx").distinct(), ["dataset_key", "problem_idx"], "left_anti")
