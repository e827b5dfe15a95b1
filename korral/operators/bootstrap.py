"""Paired cluster bootstrap over problems.

A resample is a relation (rep, pos, m): how often a replicate draws a problem.
A replicate's mean is sum(m * v) / P, so replicates cost a join of the draws
with one row per problem (its values at all ks), never the samples.  Both sides
are shuffled by the problem, whatever their estimated sizes: neither the draws,
n_boot times the problems, nor the problems ever go through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korral.functions.stats import DEFAULT_KS, pass_at_k

#: Draws that a task makes at most.
DRAWS = 1_000_000


def numbered(problems: DataFrame) -> DataFrame:
    """Problems with their position on the sorted axis. One row per problem: small beside the samples."""
    return problems.withColumn("pos", F.row_number().over(W.orderBy("dataset_key", "problem_idx")) - 1)


def hash_draws(spark: SparkSession, n_problems: int, n_boot: int) -> DataFrame:
    """(rep, pos, m) from a hash of (rep, slot): the same in any engine with md5, made on the executors.

    A range over all draws rather than an exploded row per replicate: tasks and estimated size grow with the draws.
    """
    n = n_boot * n_problems
    slots = spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, -(-n // DRAWS))).select(F.expr(f"id div {n_problems}").alias("rep"), F.expr(f"id % {n_problems}").alias("slot"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("slot").cast("string"))), 1, 15), 16, 10).cast("bigint")
    # Dealt by pos alone, which serves the counts and the joins by pos in one shuffle.
    return slots.select("rep", (h % n_problems).alias("pos")).repartition("pos").groupBy("rep", "pos").agg(F.count("*").alias("m"))


def generator_draws(spark: SparkSession, n_problems: int, n_boot: int, seed: int = 0) -> DataFrame:
    """(rep, pos, m) from a seeded numpy generator, for results that match a numpy bootstrap draw for draw."""
    idx = np.random.default_rng(seed).integers(0, n_problems, size=(n_boot, n_problems))
    rows = [(r, int(p), int(m)) for r in range(n_boot) for p, m in zip(*np.unique(idx[r], return_counts=True), strict=True)]
    return spark.createDataFrame(rows, "rep long, pos int, m long")


def _values(pairs: DataFrame, ks: tuple[int, ...], *keep: str) -> DataFrame:
    """A row per problem: n, the samples that both arms have, and b<k>, r<k>, null where n doesn't support k."""
    n = F.least("nb", "nr")
    at = lambda a, k: F.when(n >= k, pass_at_k(F.col(f"n{a}"), F.col(f"c{a}"), F.lit(k))).alias(f"{a}{k}")
    return pairs.select(*keep, n.alias("n"), *(at(a, k) for a in "br" for k in ks))


def _means(rows: DataFrame, m: Column, ks: tuple[int, ...], *by: str) -> DataFrame:
    """(by, k, b, r): means weighted by m over the rows that support k; no row where none does. Widened to rows by k only after the sums."""
    weight = lambda k: F.sum(F.when(F.col("n") >= k, m))
    mean = lambda a, k: (F.sum(m * F.col(f"{a}{k}")) / weight(k)).alias(f"{a}{k}")
    wide = rows.groupBy(*by).agg(*(mean(a, k) for a in "br" for k in ks), *(weight(k).alias(f"w{k}") for k in ks))
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"w{k}").alias("w"), F.col(f"b{k}").alias("b"), F.col(f"r{k}").alias("r")) for k in ks)))
    return wide.select(*by, at.alias("x")).where("x.w is not null").select(*by, "x.k", "x.b", "x.r")


def replicate_curves(pairs: DataFrame, draws: DataFrame, ks: tuple[int, ...] = DEFAULT_KS) -> DataFrame:
    """(rep, k, b, r): each replicate's mean curves."""
    # Numbering takes one task; the estimators run behind the shuffle that the join needs anyway.
    placed = numbered(pairs).withColumn("pos", F.col("pos").cast("bigint")).repartition("pos")
    return _means(draws.join(_values(placed, ks, "pos").hint("shuffle_hash"), "pos"), F.col("m"), ks, "rep")


def point_curves(pairs: DataFrame, ks: tuple[int, ...] = DEFAULT_KS) -> DataFrame:
    """(k, b, r): the mean curves over the problems themselves."""
    return _means(_values(pairs, ks), F.lit(1), ks)


def bootstrap_gap(pairs: DataFrame, draws: DataFrame, ks: tuple[int, ...] = DEFAULT_KS, alpha: float = 0.05) -> DataFrame:
    """(k, base, rl, gap, lo, hi): base minus rl with its percentile interval."""
    reps = replicate_curves(pairs, draws, ks).groupBy("k").agg(F.percentile(F.col("b") - F.col("r"), F.lit(alpha / 2)).alias("lo"), F.percentile(F.col("b") - F.col("r"), F.lit(1 - alpha / 2)).alias("hi"))
    point = point_curves(pairs, ks).select("k", F.col("b").alias("base"), F.col("r").alias("rl"))
    return point.join(reps, "k").select("k", "base", "rl", (F.col("base") - F.col("rl")).alias("gap"), "lo", "hi")


def bootstrap_mean(pairs: DataFrame, draws: DataFrame, ks: tuple[int, ...] = DEFAULT_KS, alpha: float = 0.05) -> DataFrame:
    """(k, mean, lo, hi) of the base arm alone."""
    reps = replicate_curves(pairs, draws, ks).groupBy("k").agg(F.percentile("b", F.lit(alpha / 2)).alias("lo"), F.percentile("b", F.lit(1 - alpha / 2)).alias("hi"))
    return point_curves(pairs, ks).select("k", F.col("b").alias("mean")).join(reps, "k")


def bootstrap_crossover(pairs: DataFrame, draws: DataFrame, ks: tuple[int, ...] = DEFAULT_KS, alpha: float = 0.05) -> DataFrame:
    """p_exists, and median and interval of k* over the replicates that cross."""
    reps = replicate_curves(pairs, draws, ks).groupBy("rep").agg(F.min(F.when(F.round("b", 12) >= F.round("r", 12), F.col("k"))).alias("k"))
    q = lambda p: F.percentile("k", F.lit(p))
    return reps.agg((F.count("k") / F.count("*")).alias("p_exists"), q(alpha / 2).alias("lo"), q(0.5).alias("median"), q(1 - alpha / 2).alias("hi"))
