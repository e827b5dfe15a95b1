"""The analysis as one call, and its sinks: JSON summary, CSV and LaTeX tables, plot data."""

from __future__ import annotations

import csv
import io
import json
import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korral.functions.stats import clopper_pearson
from korral.operators import bootstrap as B
from korral.operators import curves as C
from korral.operators import lattice as L
from korral.operators import tensor as X
from korral.sources.tree import write_text


def cell(x: Any, places: int = 3) -> str:
    """A table cell: NaN and null as ``--``, no negative zero, and never an infinity."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return "--"
    if not isinstance(x, float):
        return str(x)
    if math.isinf(x):
        raise ValueError("an infinite value in a table")
    text = f"{x:.{places}f}"
    return text.lstrip("-") if float(text) == 0 else text


def latex(columns: list[str], rows: list[tuple], caption: str, label: str, places: int = 3) -> str:
    line = lambda cells: " & ".join(cells) + r" \\"
    head = line(c.replace("_", r"\_") for c in columns)
    body = "\n".join(line(cell(x, places) for x in r) for r in rows)
    text = f"""\\begin{{table}}[t]
\\centering
\\small
\\begin{{tabular}}{{l{'r' * (len(columns) - 1)}}}
\\toprule
{head}
\\midrule
{body}
\\bottomrule
\\end{{tabular}}
\\caption{{{caption}}}
\\label{{{label}}}
\\end{{table}}
"""
    if text.count("{") != text.count("}"):
        raise ValueError(f"unbalanced braces in table {label}")
    return text


def write_table(df: DataFrame, path: str, caption: str, label: str, places: int = 3) -> None:
    """A small result as path.csv and path.tex."""
    rows = [tuple(r) for r in df.collect()]
    out = io.StringIO()
    sheet = csv.writer(out, lineterminator="\n")
    sheet.writerow(df.columns)
    sheet.writerows(["" if x is None else x for x in r] for r in rows)
    write_text(df.sparkSession, f"{path}.csv", out.getvalue(), replace=True)
    write_text(df.sparkSession, f"{path}.tex", latex(df.columns, rows, caption, label, places), replace=True)


def decomposition_table(rows: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """The decomposition with the intervals of its players, if any."""
    if intervals is None:
        return rows.orderBy("confound")
    return rows.join(F.broadcast(intervals.select("confound", F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))), "confound", "left").orderBy("confound")


def hard_zero_bounds(table: DataFrame, n: int) -> dict[str, Any]:
    """What the 2x2 table allows: shares with exact intervals, and the rate that no hit in n samples still allows."""
    t = table.first()
    total = t.both + t.expansion + t.lost + t.neither
    return {
        "frac_expansion": t.expansion / total, "ci_expansion": clopper_pearson(t.expansion, total),
        "frac_lost": t.lost / total, "ci_lost": clopper_pearson(t.lost, total),
        "upper_rate_if_zero": clopper_pearson(0, n)[1],
    }


class Analysis:
    """The whole comparison of two arms over graded samples (columns of the tensor operators, and release_date).

    The truncated samples and the per-problem counts are kept: each later part reads those.
    """

    def __init__(self, samples: DataFrame, base: str = "base", rl: str = "rl", n_boot: int = 2000, n_boot_lattice: int = 500, settings: L.Settings = L.Settings(), seed: int | None = None, strict: bool = True, expected: DataFrame | None = None) -> None:
        named = X.pick_models(samples, [base, rl]).withColumn("model_key", F.when(F.col("model_key") == base, "base").otherwise("rl"))
        if bad := X.impure_arms(named).limit(3).collect():
            raise ValueError(f"arms that mix variants or sampling: {bad}")
        if expected is not None and (gone := X.absent_problems(named, expected).limit(3).collect()):
            raise ValueError(f"problems without any sample: {gone}")
        if "alt_correct" not in named.columns:
            named = named.withColumn("alt_correct", F.col("correct"))
        self.samples = X.truncated(X.require_no_nulls(named, "correct", "nullgold"), strict).persist()
        self.counts = X.dense_counts(self.samples, F.col("correct")).persist()
        self.pairs = C.paired(self.counts).persist()
        self.settings, spark = settings, samples.sparkSession
        self.n_problems = self.pairs.count()
        draw = (lambda n: B.hash_draws(spark, self.n_problems, n)) if seed is None else (lambda n: B.generator_draws(spark, self.n_problems, n, seed))
        self.draws, self.lattice_draws = draw(n_boot), draw(n_boot_lattice)

    def gap(self) -> DataFrame:
        return B.bootstrap_gap(self.pairs, self.draws)

    def crossover(self) -> DataFrame:
        return C.crossover(C.curve(self.counts)).crossJoin(B.bootstrap_crossover(self.pairs, self.draws))

    def decomposition(self) -> DataFrame:
        gaps = L.lattice(L.cell_sums(L.problem_states(self.samples, self.settings)))
        return L.decomposition(L.require_strata(gaps))

    def intervals(self) -> DataFrame:
        return L.bootstrap_shapley(self.samples, self.lattice_draws, self.settings)

    def figures(self) -> dict[str, DataFrame]:
        """The data of each plot."""
        curves = C.curve(self.counts)
        tokens = self.samples.groupBy("model_key").agg(F.avg("n_completion_tokens").alias("mean_tokens"))
        return {
            "curves": curves, "gap": self.gap(), "waterfall": L.waterfall(self.decomposition()), "hard_zero": C.hard_zero(self.pairs),
            "cdf": C.solve_rate_cdf(self.counts), "iso_compute": C.iso_compute(curves, tokens),
        }

    def summary(self) -> dict[str, Any]:
        n = self.counts.agg(F.max("n")).first()[0]
        gap = {r.k: r for r in self.gap().collect()}
        top = max(gap)
        cross, zero = self.crossover().first(), C.hard_zero(self.pairs)
        parts = {r.confound: r.shapley for r in self.decomposition().collect()}
        arms = self.samples.groupBy("model_key").agg(F.avg(F.col("nullgold").cast("int")).alias("phi"), F.avg((F.col("answer_token_pos") < 0).cast("int")).alias("no_answer"), F.avg("n_completion_tokens").alias("tokens")).collect()
        return {
            "n_problems": self.n_problems, "n_samples": n,
            "pass_at_1": {"base": gap[1].base, "rl": gap[1].rl},
            f"pass_at_{top}": {"base": gap[top].base, "rl": gap[top].rl},
            f"gap_at_{top}": gap[top].gap, f"gap_ci_at_{top}": [gap[top].lo, gap[top].hi],
            "crossover": {"k_star": cross.k_star, "p_exists": cross.p_exists, "ci_conditional": [cross.lo, cross.hi], "median": cross["median"]},
            "hard_zero": zero.first().asDict() | hard_zero_bounds(zero, n),
            "decomposition": {"raw_gap": sum(parts.values()), "residual_C1": parts["C1"], "shapley": {k: v for k, v in parts.items() if k != "C1"}, "ci": {r.confound: [r.lo, r.hi] for r in self.intervals().collect()}},
            "nullgold_phi": {r.model_key: r.phi for r in arms}, "no_answer_rate": {r.model_key: r.no_answer for r in arms}, "mean_completion_tokens": {r.model_key: r.tokens for r in arms},
        }

    def write(self, out: str) -> None:
        """summary.json, the decomposition as CSV and LaTeX, and each plot's data as CSV."""
        spark = self.samples.sparkSession
        write_text(spark, f"{out}/summary.json", json.dumps(self.summary(), default=str, indent=1, sort_keys=True), replace=True)
        write_table(decomposition_table(self.decomposition(), self.intervals()), f"{out}/decomposition", "Decomposition of the gap.", "tab:decomposition")
        for name, df in self.figures().items():
            write_table(df, f"{out}/{name}", name.replace("_", " "), f"tab:{name}")
