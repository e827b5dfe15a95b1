"""pass@k curves, support measures and crossovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korral.functions.stats import DEFAULT_KS, naive_pass_at_k, pass_at_k


def usable(n: Column, ks: tuple[int, ...] = DEFAULT_KS) -> Column:
    """The ks that n samples support."""
    return F.filter(F.array(*map(F.lit, ks)), lambda k: k <= n)


def curve(counts: DataFrame, ks: tuple[int, ...] = DEFAULT_KS, by: tuple[str, ...] = ("model_key",), naive: bool = False) -> DataFrame:
    """Mean pass@k over problems. The estimator runs once per distinct (n, c), not once per problem."""
    kinds = counts.groupBy(*by, "n", "c").agg(F.count("*").alias("problems")).withColumn("k", F.explode(usable(F.col("n"), ks)))
    kinds = kinds.withColumn("v", pass_at_k(F.col("n"), F.col("c"), F.col("k"))).withColumn("w", naive_pass_at_k(F.col("n"), F.col("c"), F.col("k")))
    mean = lambda c: F.sum(F.col(c) * F.col("problems")) / F.sum("problems")
    out = [mean("v").alias("pass_at_k")] + ([mean("w").alias("naive")] if naive else [])
    return kinds.groupBy(*by, "k").agg(*out)


def solve_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumn("rate", F.col("c") / F.col("n"))


def paired(counts: DataFrame, base: str = "base", rl: str = "rl") -> DataFrame:
    """One row per problem: cb, cr, nb, nr."""
    pick = lambda m, c: F.max(F.when(F.col("model_key") == m, F.col(c)))
    return counts.groupBy("dataset_key", "problem_idx").agg(pick(base, "c").alias("cb"), pick(rl, "c").alias("cr"), pick(base, "n").alias("nb"), pick(rl, "n").alias("nr"))


def hard_zero(pairs: DataFrame) -> DataFrame:
    """The 2x2 table of problems that either arm ever solves."""
    b, r = F.col("cb") > 0, F.col("cr") > 0
    return pairs.agg(F.count_if(b & r).alias("both"), F.count_if(~b & r).alias("expansion"), F.count_if(b & ~r).alias("lost"), F.count_if(~b & ~r).alias("neither"))


def hard_zero_members(pairs: DataFrame) -> DataFrame:
    """Each problem's cell; rows rather than lists, which would grow with the problems."""
    cell = F.when((F.col("cb") > 0) & (F.col("cr") > 0), "both").when(F.col("cr") > 0, "expansion").when(F.col("cb") > 0, "lost").otherwise("neither")
    return pairs.select("dataset_key", "problem_idx", cell.alias("cell"))


def solve_rate_cdf(rates: DataFrame, points: int = 101) -> DataFrame:
    """ECDF of the solve rates on an even grid: how many fall in each grid cell, then a running sum over the grid."""
    step = points - 1
    at = F.explode(F.sequence(F.lit(0), F.lit(step))).alias("i")
    kinds = rates.groupBy("model_key", "n", "c").agg(F.count("*").alias("m"))
    each = kinds.select("*", at).withColumn("hit", F.when(F.col("c") / F.col("n") <= F.col("i") / step, F.col("m")).otherwise(0))
    return each.groupBy("model_key", "i").agg((F.sum("hit") / F.sum("m")).alias("cdf")).select("model_key", (F.col("i") / step).alias("grid"), "cdf")


def rate_summary(rates: DataFrame) -> DataFrame:
    return rates.groupBy("model_key").agg(F.avg((F.col("c") == 0).cast("int")).alias("frac_zero"), F.avg((F.col("c") == F.col("n")).cast("int")).alias("frac_one"), F.avg(F.col("c") / F.col("n")).alias("mean_rate"))


def answer_breadth(df: DataFrame, answer: Column, correct: Column) -> DataFrame:
    """Distinct wrong answers and their entropy (nats) of each model and problem; 0 without any."""
    key = ["model_key", "dataset_key", "problem_idx"]
    each = df.groupBy(*key, F.when(~correct, answer).alias("a")).agg(F.count("*").alias("m"))
    # -sum(q ln q) with q = m / t is ln t - sum(m ln m) / t: one pass, no join back to the totals.
    wrong = F.col("a").isNotNull()
    t = F.sum(F.when(wrong, F.col("m")).otherwise(0))
    h = F.when(t > 0, F.ln(t) - F.sum(F.when(wrong, F.col("m") * F.ln("m")).otherwise(0.0)) / t).otherwise(0.0)
    return each.groupBy(*key).agg(F.count_if(wrong).alias("n_wrong"), h.alias("entropy"))


def crossover(curves: DataFrame) -> DataFrame:
    """The smallest k where base is no worse than rl (ties count; null if none). Rounded, so sums in any order agree."""
    pick = lambda m: F.max(F.when(F.col("model_key") == m, F.round("pass_at_k", 12)))
    return curves.groupBy("k").agg(pick("base").alias("b"), pick("rl").alias("r")).agg(F.min(F.when(F.col("b") >= F.col("r"), F.col("k"))).alias("k_star"))


def iso_compute(curves: DataFrame, tokens: DataFrame) -> DataFrame:
    """The curves over compute: x = k times the model's mean tokens."""
    return curves.join(F.broadcast(tokens), "model_key").select("model_key", "k", (F.col("k") * F.col("mean_tokens")).alias("compute"), "pass_at_k")
