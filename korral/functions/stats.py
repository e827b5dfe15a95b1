"""Estimators as column expressions, and the exact binomial interval."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the default sample counts of a curve.
DEFAULT_KS = (1, 2, 4, 8, 16, 32, 64, 128, 256)


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Unbiased chance that one of k draws out of n samples with c hits is a hit: 1 - prod(1 - k / i), i in n-c+1..n.

    Errors: n < 0, c outside 0..n, k < 1, k > n.
    """
    n, c, k = n.cast("bigint"), c.cast("bigint"), k.cast("bigint")
    bad = (n < 0) | (c < 0) | (c > n) | (k < 1) | (k > n)
    terms = F.sequence(n - c + 1, F.greatest(n, n - c + 1))
    miss = F.aggregate(terms, F.lit(1.0), lambda a, i: a * (F.lit(1.0) - k.cast("double") / i.cast("double")))
    return F.when(bad, F.raise_error(F.lit("pass@k needs 0 <= c <= n and 1 <= k <= n")).cast("double")).when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - miss)


def naive_pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """The biased plug-in 1 - (1 - c/n)^k."""
    return F.lit(1.0) - F.pow(F.lit(1.0) - c / n, k.cast("double"))


def corrected_rate(observed: Column, phi: Column) -> Column:
    """A hit rate with the null-gold rate phi taken out, within 0..1; phi outside [0, 1) is an error."""
    ok = F.when((phi >= 0) & (phi < 1), phi).otherwise(F.raise_error(F.lit("null-gold rate outside [0, 1)")).cast("double"))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (observed - ok) / (F.lit(1.0) - ok)))


def entropy(counts: Column) -> Column:
    """Shannon entropy in nats of an array of counts; 0 for none."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(F.size(counts) == 0, F.lit(0.0)).otherwise(-F.aggregate(counts, F.lit(0.0), lambda a, x: a + x / total * F.ln(x / total)))


def at_budget(correct: Column, pos: Column, budget: Column) -> Column:
    """Correct with an answer at or before the budget; a position of -1 is no answer."""
    return correct & (pos >= 0) & (pos <= budget)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact binomial interval, by bisection on the binomial tails."""
    if n <= 0 or not 0 <= k <= n:
        raise ValueError("clopper_pearson needs 0 <= k <= n and n > 0")

    def upper_tail(p: float, at: int) -> float:  # P(X >= at)
        if p <= 0 or p >= 1:
            return float(p >= 1 or at == 0)
        logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(at, n + 1))
        return math.fsum(map(math.exp, logs))

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: upper_tail(p, k) < alpha / 2)
    high = 1.0 if k == n else solve(lambda p: 1 - upper_tail(p, k + 1) > alpha / 2)
    return low, high
