"""Adjustments of a base-vs-rl comparison, their lattice and its Shapley values.

An adjustment changes which samples count as correct, which problems weigh, or
how many samples the rl arm gets.  All of them are columns over one pass of the
samples, so all 64 subsets are read off the same 32 sums:

* correctness depends on three (shared prompt, lucky guess, truncation): eight
  counts per problem and arm;
* weights depend on two (saturation, contamination): four weights per problem;
* compute depends on one: two values of k for rl.

The order of application is fixed (saturation, contamination, shared prompt,
lucky guess, truncation, compute), which makes a subset's result independent of
how it is written down.  A subset is a bit mask over ``CONFOUNDS``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korral.functions.stats import pass_at_k

#: The operators by their bit, and their defaults.
CONFOUNDS = ("C2", "C3", "C4", "C5", "C6", "C7")
EXPLAINS = {"C2": "saturation", "C3": "contamination", "C4": "lucky guess", "C5": "truncation", "C6": "matched compute", "C7": "prompt mismatch", "C1": "residual"}
LO, HI, CUTOFF, K_REF = 0.05, 0.80, date(2025, 12, 1), 256


@dataclass(frozen=True)
class Settings:
    lo: float = LO
    hi: float = HI
    cutoff: date = CUTOFF
    k_reference: int | None = None
    k_max: int = K_REF


def budget(samples: DataFrame) -> DataFrame:
    """One row: the last base answer position (0 if none), the arms' mean tokens (1 if zero), and n."""
    base, rl = F.col("model_key") == "base", F.col("model_key") == "rl"
    mean = lambda arm: F.coalesce(F.nullif(F.avg(F.when(arm, F.col("n_completion_tokens"))), F.lit(0.0)), F.lit(1.0))
    last = F.coalesce(F.max(F.when(base & (F.col("answer_token_pos") >= 0), F.col("answer_token_pos"))), F.lit(0))
    return samples.agg(last.alias("budget"), mean(base).alias("tok_base"), mean(rl).alias("tok_rl"), F.max("n").alias("n"))


def matched_k(k_base: Column, n: Column, tok_base: Column, tok_rl: Column, k_reference: int | None = None) -> Column:
    """The k that gives rl as many tokens as the base arm's reference k."""
    ref = k_base if k_reference is None else F.lit(k_reference)
    return F.greatest(F.lit(1), F.least(n, F.floor(ref * tok_base / tok_rl))).cast("bigint")


def adjusted(budget_col: Column, mask: int) -> Column:
    """Is a sample correct under the correctness adjustments of a mask over (C7, C4, C5) as bits 1, 2, 4?"""
    ok = F.col("alt_correct") if mask & 1 else F.col("correct")
    if mask & 2:
        ok = ok & ~F.col("nullgold")
    if mask & 4:
        ok = ok & (F.col("answer_token_pos") >= 0) & (F.col("answer_token_pos") <= budget_col)
    return ok


def problem_states(samples: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A row per problem: cb and cr (arrays of eight counts by correctness mask), the weights' two bits, n and the two ks."""
    facts = budget(samples)
    rows = samples.drop("n").crossJoin(F.broadcast(facts))  # one row
    base, rl = F.col("model_key") == "base", F.col("model_key") == "rl"
    counts = lambda arm: F.array(*(F.count_if(arm & adjusted(F.col("budget"), m)) for m in range(8)))
    out = rows.groupBy("dataset_key", "problem_idx").agg(
        counts(base).alias("cb"),
        counts(rl).alias("cr"),
        F.max("release_date").alias("release_date"),
        *(F.first(c).alias(c) for c in ("n", "tok_base", "tok_rl", "budget")),
    )
    rate = F.col("cb")[0] / F.col("n")
    k_base = F.least(F.lit(settings.k_max), F.col("n")).cast("bigint")
    return out.select(
        "dataset_key",
        "problem_idx",
        "cb",
        "cr",
        "n",
        k_base.alias("k_base"),
        matched_k(k_base, F.col("n"), F.col("tok_base"), F.col("tok_rl"), settings.k_reference).alias("k_matched"),
        rate.between(settings.lo, settings.hi).cast("int").alias("w_c2"),
        (F.col("release_date") > F.lit(settings.cutoff)).cast("int").alias("w_c3"),
        "budget",
    )


def cell_sums(states: DataFrame, by: tuple[str, ...] = (), times: str = "1") -> DataFrame:
    """The 32 sums of the lattice: by correctness mask and weight mask, sum(w), sum(w * v) for base, rl, and rl at the matched k."""
    each = states.select(*by, "n", "k_base", "k_matched", "w_c2", "w_c3", F.expr(times).alias("m"), F.posexplode(F.arrays_zip("cb", "cr")).alias("cmask", "c"))
    each = each.select(
        *by, "w_c2", "w_c3", "m", "cmask",
        pass_at_k(F.col("n"), F.col("c.cb"), F.col("k_base")).alias("vb"),
        pass_at_k(F.col("n"), F.col("c.cr"), F.col("k_base")).alias("vr"),
        pass_at_k(F.col("n"), F.col("c.cr"), F.col("k_matched")).alias("vm"),
    ).withColumn("wmask", F.explode(F.sequence(F.lit(0), F.lit(3))))
    w = F.expr("m * case when wmask & 1 = 1 then w_c2 else 1 end * case when wmask & 2 = 2 then w_c3 else 1 end").cast("double")
    return each.groupBy(*by, "cmask", "wmask").agg(F.sum(w).alias("w"), *(F.sum(w * F.col(v)).alias(v) for v in ("vb", "vr", "vm")))


def lattice(sums: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(mask, g): the gap base - rl of every subset; g is null where no problem keeps a weight."""
    masks = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("mask")
    m = sums.sparkSession.range(1).select(masks)
    bit = lambda c: f"((mask div {1 << CONFOUNDS.index(c)}) % 2)"
    m = m.select("mask", F.expr(f"cast({bit('C2')} + 2 * {bit('C3')} as int)").alias("wmask"), F.expr(f"cast({bit('C7')} + 2 * {bit('C4')} + 4 * {bit('C5')} as int)").alias("cmask"), F.expr(f"{bit('C6')} = 1").alias("c6"))
    out = sums.join(F.broadcast(m), ["cmask", "wmask"])  # 64 rows
    g = F.when(F.col("w") > 0, (F.col("vb") - F.when(F.col("c6"), F.col("vm")).otherwise(F.col("vr"))) / F.col("w"))
    return out.select(*by, "mask", g.alias("g"))


def require_strata(gaps: DataFrame) -> DataFrame:
    """The gaps, failing if a subset left no problem."""
    return gaps.withColumn("g", F.when(F.col("g").isNotNull(), F.col("g")).otherwise(F.raise_error(F.concat(F.lit("no problem left in subset "), F.col("mask").cast("string"))).cast("double")))


def shapley(gaps: DataFrame, by: tuple[str, ...] = (), players: tuple[str, ...] = CONFOUNDS) -> DataFrame:
    """(confound, shapley, loo) per player: the average and the last marginal drop of the gap.

    Every subset's gap enters each player's sums once, with a sign: plain aggregation, no self-join.
    """
    n, full = len(players), sum(1 << CONFOUNDS.index(p) for p in players)
    weight = [math.factorial(r) * math.factorial(n - r - 1) / math.factorial(n) for r in range(n)]
    inside = gaps.where((F.col("mask").bitwiseAND(F.lit(63 - full))) == 0)
    each = inside.withColumn("p", F.explode(F.array(*(F.struct(F.lit(p).alias("name"), F.lit(1 << CONFOUNDS.index(p)).alias("bit")) for p in players))))
    has = F.col("mask").bitwiseAND(F.col("p.bit")) != 0
    size = F.bit_count("mask") - has.cast("int")
    w = F.element_at(F.array(*map(F.lit, weight)), size + 1)
    # v(S) = g(0) - g(S), so a marginal v(S + i) - v(S) is g(S) - g(S + i).
    phi = F.sum(w * F.when(has, -F.col("g")).otherwise(F.col("g")))
    at = lambda m: F.max(F.when(F.col("mask") == m, F.col("g")))
    out = each.groupBy(*by, F.col("p.name").alias("confound"), F.col("p.bit").alias("bit")).agg(phi.alias("shapley"), F.max(F.when(F.col("mask") == full - F.col("p.bit"), F.col("g"))).alias("g_without"), at(full).alias("g_full"), at(0).alias("g_none"))
    return out.select(*by, "confound", "shapley", (F.col("g_without") - F.col("g_full")).alias("loo"), F.col("g_none").alias("raw_gap"), F.col("g_full").alias("residual_gap"))


def decomposition(gaps: DataFrame, players: tuple[str, ...] = CONFOUNDS, atol: float = 1e-8) -> DataFrame:
    """(confound, explanation, shapley, share, loo): the players, then C1, the residual; fails if they don't add up to the raw gap."""
    phi = shapley(gaps, players=players)
    total = phi.agg(F.sum("shapley").alias("explained"), F.max("raw_gap").alias("raw_gap"), F.max("residual_gap").alias("residual"))
    off = F.abs(F.col("raw_gap") - F.col("explained") - F.col("residual"))
    rest = total.select(F.lit("C1").alias("confound"), F.when(off <= atol, F.col("residual")).otherwise(F.raise_error(F.lit("parts don't add up to the raw gap")).cast("double")).alias("shapley"), F.lit(None).cast("double").alias("loo"), "raw_gap")
    rows = phi.select("confound", "shapley", "loo", "raw_gap").unionByName(rest)
    names = F.create_map(*(F.lit(x) for kv in EXPLAINS.items() for x in kv))
    return rows.select("confound", names[F.col("confound")].alias("explanation"), "shapley", F.when(F.col("raw_gap") == 0, F.lit(0.0)).otherwise(F.col("shapley") / F.nullif(F.col("raw_gap"), F.lit(0.0))).alias("share"), "loo")


def waterfall(rows: DataFrame) -> DataFrame:
    """Running gap after taking the parts out in order: (ord, confound, shapley, running)."""
    players = rows.where("confound <> 'C1'")
    raw = rows.agg(F.sum("shapley").alias("raw"))  # parts and residual add up to the raw gap
    run = F.sum("shapley").over(W.orderBy("confound").rowsBetween(W.unboundedPreceding, 0))  # six rows
    return players.crossJoin(F.broadcast(raw)).select("confound", "shapley", (F.col("raw") - run).alias("running"))


def bootstrap_shapley(samples: DataFrame, draws: DataFrame, settings: Settings = Settings(), players: tuple[str, ...] = CONFOUNDS, alpha: float = 0.05) -> DataFrame:
    """(confound, lo, hi, n_boot_ok): percentile intervals of the Shapley values over cluster resamples of problems.

    Budgets and token means are those of each replicate.  A replicate's budget is the largest of its
    problems' last base positions, read off running sums over the positions; the samples are counted once.
    Replicates in which a subset keeps no problem are dropped.
    """
    from korral.operators.bootstrap import numbered

    base, rl = F.col("model_key") == "base", F.col("model_key") == "rl"
    mean = lambda arm: F.avg(F.when(arm, F.col("n_completion_tokens")))
    facts = samples.groupBy("dataset_key", "problem_idx").agg(F.coalesce(F.max(F.when(base & (F.col("answer_token_pos") >= 0), F.col("answer_token_pos"))), F.lit(0)).alias("last"), mean(base).alias("tb"), mean(rl).alias("tr"))
    facts = numbered(facts)
    guard = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(1.0))
    reps = draws.join(facts, "pos").groupBy("rep").agg(F.max("last").alias("budget"), guard(F.sum(F.col("m") * F.col("tb")) / F.sum("m")).alias("tok_base"), guard(F.sum(F.col("m") * F.col("tr")) / F.sum("m")).alias("tok_rl"))
    # The samples are counted once, by problem and answer position; a budget reads the running sum up to it.
    key, arms = ["dataset_key", "problem_idx"], {"b": base, "r": rl}
    names = [f"{a}{m}" for a in arms for m in range(4)]
    hits = [F.count_if(arm & adjusted(F.lit(0), m)).alias(f"{a}{m}") for a, arm in arms.items() for m in range(4)]
    by_pos = samples.groupBy(*key, F.when(F.col("answer_token_pos") >= 0, F.col("answer_token_pos")).alias("at")).agg(*hits, F.max("release_date").alias("release_date"), F.first("n").alias("n"))
    whole = by_pos.groupBy(*key).agg(*(F.sum(c).alias(c) for c in names), F.max("release_date").alias("release_date"), F.first("n").alias("n"))
    asked = whole.select(*key).crossJoin(reps.select(F.col("budget").alias("at")).distinct())
    steps = by_pos.where("at is not null").select(*key, "at", F.lit(0).alias("ask"), *names).unionByName(asked.withColumns({"ask": F.lit(1)} | {c: F.lit(0).cast("bigint") for c in names}))
    upto = W.partitionBy(*key).orderBy("at", "ask").rowsBetween(W.unboundedPreceding, 0)
    upto = steps.select(*key, F.col("at").alias("budget"), "ask", *(F.sum(c).over(upto).alias(f"{c}_") for c in names)).where("ask = 1").drop("ask")
    counts = lambda a: F.array(*(F.col(f"{a}{m}") for m in range(4)), *(F.col(f"{a}{m}_") for m in range(4)))
    per = upto.join(whole, key).select(*key, "budget", counts("b").alias("cb"), counts("r").alias("cr"), "release_date", "n")
    per = per.join(facts.select("dataset_key", "problem_idx", "pos"), ["dataset_key", "problem_idx"])
    met = draws.join(reps, "rep").join(per, ["pos", "budget"])
    k_base = F.least(F.lit(settings.k_max), F.col("n")).cast("bigint")
    states = met.select("rep", "m", "cb", "cr", "n", k_base.alias("k_base"), matched_k(k_base, F.col("n"), F.col("tok_base"), F.col("tok_rl"), settings.k_reference).alias("k_matched"), (F.col("cb")[0] / F.col("n")).between(settings.lo, settings.hi).cast("int").alias("w_c2"), (F.col("release_date") > F.lit(settings.cutoff)).cast("int").alias("w_c3"))
    gaps = lattice(cell_sums(states, ("rep",), "m"), ("rep",))
    phi = shapley(gaps, ("rep",), players)
    ok = gaps.groupBy("rep").agg(F.count_if(F.col("g").isNull()).alias("empty")).where("empty = 0").select("rep")
    q = lambda p: F.percentile("shapley", F.lit(p))
    return phi.join(ok, "rep").groupBy("confound").agg(q(alpha / 2).alias("lo"), q(1 - alpha / 2).alias("hi"), F.count("*").alias("n_boot_ok"))
