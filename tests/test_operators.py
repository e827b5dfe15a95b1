import datetime as dt
import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from korral.operators import bootstrap as B
from korral.operators import curves as C
from korral.operators import grading, mock, planning, verify
from korral.operators import lattice as L
from korral.operators import tensor as X
from korral.operators.report import Analysis, cell, latex
from korral.plans.analysis import counts

SCHEMA = "model_key string, dataset_key string, problem_idx bigint, sample_idx bigint, correct boolean, alt_correct boolean, nullgold boolean, n_completion_tokens bigint, answer_token_pos bigint, release_date date"


def arms(spark, problems=12, n=16, seed=0, alt=False, nullgold=0.1, change=None):
    r = random.Random(seed)
    rows = []
    for p in range(problems):
        rate = r.betavariate(0.9, 2.0)
        for m in ("base", "rl"):
            for i in range(n):
                hit = r.random() < (rate if m == "base" else min(0.98, rate + 0.12 * (1 - rate)))
                row = [m, f"d{p % 2}", p, i, hit, hit if not alt else r.random() < rate, r.random() < nullgold, r.randrange(200, 400) * (1 + (m == "rl")), r.randrange(10, 300 if m == "base" else 700), dt.date(2026, 1 + p % 3, 1) if p % 3 else dt.date(2025, 6, 1)]
                rows.append(change(row) if change else row)
    return spark.createDataFrame(rows, SCHEMA)


def lattice(spark, df, **kw):
    return L.lattice(L.cell_sums(L.problem_states(X.truncated(df), L.Settings(k_max=8, **kw))))


def parts(gaps):
    return {r.confound: r.shapley for r in L.decomposition(gaps).collect()}


def test_lattice_by_brute_force(spark):
    df = arms(spark, alt=True)
    rows = df.collect()
    got = {r.mask: r.g for r in lattice(spark, df).collect()}

    def passk(n, c, k):
        return 1 - np.prod([1 - k / i for i in range(n - c + 1, n + 1)]) if n - c >= k else 1.0

    budget = max([r.answer_token_pos for r in rows if r.model_key == "base" and r.answer_token_pos >= 0], default=0)
    tokens = {m: np.mean([r.n_completion_tokens for r in rows if r.model_key == m]) for m in ("base", "rl")}
    for mask in range(64):
        vb = vr = w_all = 0
        on = {c: mask >> i & 1 for i, c in enumerate(L.CONFOUNDS)}
        k_rl = int(max(1, min(16, np.floor(8 * tokens["base"] / tokens["rl"])))) if on["C6"] else 8
        for p in range(12):
            own = [r for r in rows if r.problem_idx == p]
            raw = np.mean([r.correct for r in own if r.model_key == "base"])
            w = (not on["C2"] or 0.05 <= raw <= 0.80) * (not on["C3"] or own[0].release_date > L.CUTOFF)
            ok = lambda r: (r.alt_correct if on["C7"] else r.correct) and not (on["C4"] and r.nullgold) and not (on["C5"] and not 0 <= r.answer_token_pos <= budget)
            vb += w * passk(16, sum(ok(r) for r in own if r.model_key == "base"), 8)
            vr += w * passk(16, sum(ok(r) for r in own if r.model_key == "rl"), k_rl)
            w_all += w
        assert got[mask] == pytest.approx((vb - vr) / w_all, abs=1e-12)


def test_axioms(spark):
    gaps = lattice(spark, arms(spark)).persist()
    phi = parts(gaps)
    raw = gaps.where("mask = 0").first().g
    assert sum(phi.values()) == pytest.approx(raw, abs=1e-12)
    assert phi["C7"] == pytest.approx(0, abs=1e-12)  # the alternative is the original: a null player


def test_injected_truncation_goes_to_truncation(spark):
    def late(row):
        row[4] = row[5] = row[3] % 2 == 0
        row[6], row[7], row[8], row[9] = False, 100, 50 if row[0] == "base" else (5000 if row[3] % 4 == 0 else 40), dt.date(2026, 5, 1)
        return row

    phi = parts(lattice(spark, arms(spark, change=late)))
    assert abs(phi["C5"]) > 1e-3 and all(abs(v) < 1e-9 for k, v in phi.items() if k not in ("C5", "C1"))


def test_symmetric_players_share(spark):
    def mask(row):
        bad = row[0] == "rl" and row[3] % 2 == 0
        row[4] = row[5] = row[3] % 4 < 2
        row[6], row[7], row[8], row[9] = bad, 100, -1 if bad else 10, dt.date(2026, 5, 1)
        return row

    phi = parts(lattice(spark, arms(spark, change=mask)))
    assert phi["C4"] == pytest.approx(phi["C5"], abs=1e-12)


def test_empty_stratum_fails(spark):
    def solved(row):
        row[4] = row[5] = True
        return row

    with pytest.raises(Exception, match="no problem left"):
        L.require_strata(lattice(spark, arms(spark, change=solved))).collect()


def test_null_grades_fail(spark):
    df = arms(spark).withColumn("correct", F.when(F.col("sample_idx") != 3, F.col("correct")))
    with pytest.raises(Exception, match="null in correct"):
        X.require_no_nulls(df, "correct").collect()
    with pytest.raises(KeyError):
        X.require_no_nulls(df, "correct__other")


def test_truncation_is_deterministic(spark):
    df = arms(spark).where("not (problem_idx = 3 and model_key = 'rl' and sample_idx % 2 = 0)")
    assert {(r.n, r.m) for r in X.truncated(df).groupBy("model_key", "problem_idx").agg(F.max("n").alias("n"), F.count("*").alias("m")).collect()} == {(8, 8)}
    with pytest.raises(ValueError, match="ragged"):
        X.truncated(df, strict=True)
    with pytest.raises(ValueError, match="no graded rows"):
        X.pick_models(df, ["base", "other"])


def test_draws_match_numpy(spark):
    got = {}
    for r in B.generator_draws(spark, 12, 5).collect():
        got.setdefault(r.rep, []).extend([r.pos] * r.m)
    want = np.random.default_rng(0).integers(0, 12, size=(5, 12))
    assert sorted(got[0]) == sorted([10, 7, 6, 3, 3, 0, 0, 0, 2, 9, 7, 10]) and all(sorted(got[i]) == sorted(want[i]) for i in range(5))
    h = B.hash_draws(spark, 12, 7).groupBy("rep").agg(F.sum("m").alias("m")).collect()
    assert len(h) == 7 and all(r.m == 12 for r in h)


def test_hash_draws_are_those_of_md5(spark):
    want = {}
    for rep in range(7):
        for slot in range(12):
            at = rep, int(hashlib.md5(f"{rep}|{slot}".encode()).hexdigest()[:15], 16) % 12
            want[at] = want.get(at, 0) + 1
    assert {(r.rep, r.pos): r.m for r in B.hash_draws(spark, 12, 7).collect()} == want
    assert B.hash_draws(spark, 0, 7).collect() == []


PAIRS = "dataset_key string, problem_idx bigint, cb bigint, cr bigint, nb bigint, nr bigint"


def test_draws_and_problems_are_never_broadcast(spark):
    """Draws that explode out of a row per replicate looked tiny, and went through the driver."""
    draws = B.hash_draws(spark, 60_000, 200)
    assert draws._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 8 * 200 * 60_000
    few = spark.createDataFrame([("d", i, i % 3, i % 2, 4, 4) for i in range(5)], PAIRS)
    for d in (draws, B.hash_draws(spark, 5, 3)):
        plan = B.replicate_curves(few, d)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Broadcast" not in plan


def test_replicates_by_hand(spark):
    """Problems that support different ks: each k's mean is over those that support it."""
    rows = [("d", 0, 1, 0, 2, 2), ("d", 1, 0, 3, 8, 4), ("e", 0, 8, 8, 8, 8), ("e", 1, 3, 5, 8, 8)]
    drawn = {0: [0, 0, 1, 3], 1: [0, 0, 0, 0], 2: [3, 2, 2, 3]}

    def curves(rows):
        out = {}
        for k in (1, 2, 4, 8):
            at = [[1 - math.comb(n - c, k) / math.comb(n, k) for c, n in ((cb, nb), (cr, nr))] for _, _, cb, cr, nb, nr in rows if k <= min(nb, nr)]
            if at:
                out[k] = pytest.approx(tuple(np.mean(at, axis=0)))
        return out

    pairs = spark.createDataFrame(rows, PAIRS)
    draws = spark.createDataFrame([(rep, p, at.count(p)) for rep, at in drawn.items() for p in set(at)], "rep long, pos long, m long")
    got = {}
    for r in B.replicate_curves(pairs, draws).collect():
        got.setdefault(r.rep, {})[r.k] = (r.b, r.r)
    assert got == {rep: curves([rows[p] for p in at]) for rep, at in drawn.items()}
    assert {r.k: (r.b, r.r) for r in B.point_curves(pairs).collect()} == curves(rows)
    assert B.point_curves(pairs.limit(0)).collect() == []


def test_truncation_by_known_sizes(spark):
    df = arms(spark).where("not (problem_idx = 3 and model_key = 'rl' and sample_idx % 2 = 0)")
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(X.truncated(df, sizes=X.group_sizes(df))) == rows(X.truncated(df))


def test_counts_shuffle_the_samples_once(spark, sf):
    """Row number and rank, each once: all that is counted reads one shuffle of the samples."""
    df = counts(spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Window [") == 2 and plan.count("Exchange hashpartitioning(model_key") == 2  # the samples, and the groups' sizes


def test_derangement():
    assert grading.derangement(12, 0) == [9, 2, 7, 4, 5, 11, 0, 3, 6, 10, 8, 1]
    assert all(i != j for n in (2, 3, 7, 40) for i, j in enumerate(grading.derangement(n, 1)))


def test_breadth_without_wrong_answers(spark):
    df = arms(spark).withColumn("a", F.when(F.col("problem_idx") != 1, (F.col("sample_idx") % 3).cast("string")))
    out = {(r.model_key, r.problem_idx): r for r in C.answer_breadth(df, F.col("a"), F.col("correct")).collect()}
    assert len(out) == 24 and out["base", 1].n_wrong == 0 and out["base", 1].entropy == 0


def test_tables():
    assert [cell(x) for x in (None, float("nan"), -0.0001, 1.23456, 7, "a_b")] == ["--", "--", "0.000", "1.235", "7", "a_b"]
    with pytest.raises(ValueError):
        cell(float("inf"))
    text = latex(["a_b", "c"], [("x", 1.0)], "Cap.", "tab:x")
    assert r"a\_b & c \\" in text and text.count("{") == text.count("}")
    with pytest.raises(ValueError):
        latex(["a"], [("{",)], "c", "l")


PROBLEMS = "problem_idx bigint, problem_uid string, dataset_key string, question string, answer string"


def test_mock_pipeline_recovers_the_truth(spark):
    """Plan, generate, grade and analyse; the curves must meet 1 - (1 - p)^k."""
    problems = spark.createDataFrame([(i, f"uid{i}", "d", f"q{i}", str(i)) for i in range(12)], PROBLEMS)
    plan = planning.build_plan(spark.createDataFrame([("e", m, "d", "v", "s", 128, 32) for m in ("base", "rl")], "exp_id string, model_key string, dataset_key string, variant string, sampling_id string, n_total bigint, chunk_size bigint"), problems, 2)
    assert plan.count() == 2 * 2 * 4 and plan.select("unit_id").distinct().count() == 16
    reqs = planning.requests(plan, problems).withColumn("seed", F.xxhash64("model_key", "problem_idx", "sample_idx").bitwiseAND(F.lit((1 << 40) - 1)))
    rows = planning.generate(reqs, mock.backend(dirty=False), mock.SCHEMA)
    graded = grading.grade(rows, problems, grading.permuted_golds(problems, seed=0)).withColumn("correct", F.col("correct__fastint__boxed_strict")).withColumn("nullgold", F.col("nullgold__fastint__boxed_strict")).withColumn("release_date", F.lit("2026-05-01").cast("date")).persist()
    assert graded.count() == 2 * 12 * 128 and verify.duplicate_uids(graded).isEmpty() and verify.ragged(graded).isEmpty()
    a = Analysis(graded, n_boot=50, n_boot_lattice=4, settings=L.Settings(k_max=64, lo=0.0, hi=1.0))
    curve = {(r.model_key, r.k): r.pass_at_k for r in C.curve(a.counts).collect()}
    for m in ("base", "rl"):
        for k in (1, 8, 64):
            truth = np.mean([1 - (1 - mock.solve_rate(f"uid{i}", m == "rl")) ** k for i in range(12)])
            assert curve[m, k] == pytest.approx(truth, abs=0.06)
    s = a.summary()
    assert s["n_samples"] == 128 and abs(s["decomposition"]["raw_gap"] - s["gap_at_64"] if "gap_at_64" in s else 0) < 1e-6
    json.dumps(s, default=str)


def test_generation_must_match_requests(spark):
    reqs = spark.createDataFrame([("a",), ("b",)], "sample_uid string").coalesce(1)
    with pytest.raises(Exception, match="don't match"):
        planning.generate(reqs, lambda b: b.iloc[:1], "sample_uid string").collect()
    got = planning.replay(reqs, spark.createDataFrame([("a", "t"), ("b", "u")], "request_id string, text string")).collect()
    assert {(r.sample_uid, r.text) for r in got} == {("a", "t"), ("b", "u")}
    with pytest.raises(Exception, match="no recorded sample"):
        planning.replay(reqs, spark.createDataFrame([("a", "t")], "request_id string, text string")).collect()


@pytest.mark.parametrize("n,w", [(1, 1), (7, 3), (12, 16), (60, 8)])
def test_shards_partition_the_problems(spark, n, w):
    arms_ = spark.createDataFrame([("e", "m", "d", "v", "s", 4, 4)], "exp_id string, model_key string, dataset_key string, variant string, sampling_id string, n_total bigint, chunk_size bigint")
    plan = planning.build_plan(arms_, spark.range(n).select(F.lit("d").alias("dataset_key"), F.col("id").alias("problem_idx")), w).collect()
    got = sorted(i for r in plan for i in r.problem_idxs)
    assert got == list(range(n)) and max(len(r.problem_idxs) for r in plan) - min(len(r.problem_idxs) for r in plan) <= 1
    with pytest.raises(ValueError):
        planning.check_worker(w, w)


def test_report_text(spark):
    rows = spark.createDataFrame([("incomplete", "warning", "a", "1")], "check string, severity string, arm string, detail string")
    assert verify.render(rows)[0]
    ok, text = verify.render(rows.union(spark.createDataFrame([("ragged", "error", "a", "1..2")], rows.schema)))
    assert not ok and text.startswith("FAIL") and "ragged: 1" in text
