"""Queries and oracles of the statistical operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korral.functions.stats import at_budget, corrected_rate, naive_pass_at_k, pass_at_k
from korral.operators import bootstrap as B
from korral.operators import curves as C
from korral.operators import lattice as L
from korral.operators import tensor as X
from korral.plans.adapter import SQL, samples, sql_pass_at_k, sql_pass_at_k_gamma, trimmed

N_BOOT, N_BOOT_LATTICE = 200, 20
SETTINGS = L.Settings(k_max=16)
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = SQL + sql
        return f

    return put


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dense_counts(trimmed(spark, sf_dir), F.col("correct"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paired(counts(spark, sf_dir))


def r(c: str, places: int = 8):
    return F.round(c, places).alias(c)


@query("passk_curve", f"SELECT model_key, k, round(avg({sql_pass_at_k_gamma('n', 'c', 'k')}), 6) AS pass_at_k FROM c, ks WHERE k <= n GROUP BY ALL")
def passk_curve(spark, d):
    return C.curve(counts(spark, d)).select("model_key", "k", r("pass_at_k", 6))


@query("naive_vs_unbiased", f"SELECT model_key, k, round(avg({sql_pass_at_k('n', 'c', 'k')}), 8) AS pass_at_k, round(avg(1 - power(1 - c / n, k)), 8) AS naive FROM c, ks WHERE k <= n GROUP BY ALL")
def naive_vs_unbiased(spark, d):
    return C.curve(counts(spark, d), naive=True).select("model_key", "k", r("pass_at_k"), r("naive"))


@query("passk_per_problem", f"SELECT model_key, dataset_key, problem_idx, c, n, round({sql_pass_at_k('n', 'c', '8')}, 8) AS pass_at_8 FROM c")
def passk_per_problem(spark, d):
    return counts(spark, d).select("model_key", "dataset_key", "problem_idx", "c", "n", F.round(pass_at_k(F.col("n"), F.col("c"), F.lit(8)), 8).alias("pass_at_8"))


@query("tensor_trim", "SELECT model_key, dataset_key, problem_idx, count(*) AS n_used, max(sample_idx) AS last_sample, min(n) AS n FROM t GROUP BY ALL")
def tensor_trim(spark, d):
    return trimmed(spark, d).groupBy("model_key", "dataset_key", "problem_idx").agg(F.count("*").alias("n_used"), F.max("sample_idx").alias("last_sample"), F.min("n").alias("n"))


@query("group_sizes", "SELECT * FROM g")
def group_sizes(spark, d):
    return X.group_sizes(samples(spark, d))


@query("ragged_tensor_arms", "SELECT model_key, dataset_key, min(n_raw) AS n_min, max(n_raw) AS n_max, min(n_raw) < max(n_raw) AS ragged FROM g GROUP BY ALL")
def ragged_tensor_arms(spark, d):
    return X.ragged_arms(samples(spark, d))


@query(
    "dense_grid",
    """, h AS (SELECT * FROM c WHERE NOT (model_key = 'rl' AND problem_idx % 5 = 0)),
q AS (SELECT DISTINCT dataset_key, problem_idx FROM h), m AS (SELECT DISTINCT model_key FROM h)
SELECT m.model_key, q.dataset_key, q.problem_idx, coalesce(h.c, 0) AS c, (SELECT max(n) FROM h) AS n
FROM m CROSS JOIN q LEFT JOIN h ON h.model_key = m.model_key AND h.dataset_key = q.dataset_key AND h.problem_idx = q.problem_idx""",
)
def dense_grid(spark, d):
    """The dense grid where one arm lacks problems."""
    rows = trimmed(spark, d).where("not (model_key = 'rl' and problem_idx % 5 = 0)")
    return X.dense_counts(rows, F.col("correct")).select("model_key", "dataset_key", "problem_idx", "c", "n")


@query("absent_problems", ", e AS (SELECT DISTINCT 'd' || (s_suppkey % 4) AS dataset_key, CAST(floor(s_suppkey / 3) AS BIGINT) AS problem_idx FROM supplier) SELECT e.* FROM e ANTI JOIN s USING (dataset_key, problem_idx)")
def absent_problems(spark, d):
    expected = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("concat('d', cast(s_suppkey % 4 as string)) AS dataset_key", "cast(floor(s_suppkey / 3) as bigint) AS problem_idx").distinct()
    return X.absent_problems(samples(spark, d), expected)


@query("missing_models", ", m AS (SELECT unnest(['base', 'rl', 'rl-late']) AS model_key) SELECT m.* FROM m ANTI JOIN s USING (model_key)")
def missing_models(spark, d):
    return X.missing_models(samples(spark, d), spark.createDataFrame([("base",), ("rl",), ("rl-late",)], "model_key string"))


@query("impure_arms", ", v AS (SELECT *, CASE WHEN dataset_key = 'd1' AND l_linenumber = 7 THEN 'chat' ELSE 'plain' END AS variant FROM s) SELECT model_key, dataset_key, count(DISTINCT variant) AS n_variant FROM v GROUP BY ALL HAVING count(DISTINCT variant) > 1")
def impure_arms(spark, d):
    v = F.when((F.col("dataset_key") == "d1") & (F.col("l_linenumber") == 7), "chat").otherwise("plain")
    return X.impure_arms(samples(spark, d, "l_linenumber").withColumn("variant", v))


@query("solve_counts", "SELECT model_key, dataset_key, problem_idx, c, n, round(c / n, 8) AS rate FROM c")
def solve_counts(spark, d):
    return C.solve_rates(counts(spark, d)).select("model_key", "dataset_key", "problem_idx", "c", "n", r("rate"))


@query("hard_zero_2x2", "SELECT count(*) FILTER (cb > 0 AND cr > 0) AS both, count(*) FILTER (cb = 0 AND cr > 0) AS expansion, count(*) FILTER (cb > 0 AND cr = 0) AS lost, count(*) FILTER (cb = 0 AND cr = 0) AS neither FROM p")
def hard_zero_2x2(spark, d):
    return C.hard_zero(pairs(spark, d))


@query("hard_zero_members", "SELECT dataset_key, problem_idx, CASE WHEN cb > 0 AND cr > 0 THEN 'both' WHEN cr > 0 THEN 'expansion' WHEN cb > 0 THEN 'lost' ELSE 'neither' END AS cell FROM p")
def hard_zero_members(spark, d):
    return C.hard_zero_members(pairs(spark, d))


@query("solve_rate_cdf", ", i AS (SELECT unnest(range(101)) AS i) SELECT model_key, round(i / 100, 8) AS grid, round(avg(CASE WHEN c / n <= i / 100 THEN 1.0 ELSE 0.0 END), 8) AS cdf FROM c, i GROUP BY ALL")
def solve_rate_cdf(spark, d):
    return C.solve_rate_cdf(counts(spark, d)).select("model_key", r("grid"), r("cdf"))


@query("rate_summary", "SELECT model_key, round(avg((c = 0)::INT), 8) AS frac_zero, round(avg((c = n)::INT), 8) AS frac_one, round(avg(c / n), 8) AS mean_rate FROM c GROUP BY ALL")
def rate_summary(spark, d):
    return C.rate_summary(counts(spark, d)).select("model_key", r("frac_zero"), r("frac_one"), r("mean_rate"))


@query(
    "answer_breadth",
    """, a AS (SELECT model_key, dataset_key, problem_idx, answer, count(*) AS m FROM t WHERE NOT correct GROUP BY ALL),
b AS (SELECT model_key, dataset_key, problem_idx, count(*) AS n_wrong, entropy_ AS entropy FROM (
  SELECT *, -sum(m / tot * ln(m / tot)) OVER (PARTITION BY model_key, dataset_key, problem_idx) AS entropy_ FROM (
    SELECT *, sum(m) OVER (PARTITION BY model_key, dataset_key, problem_idx) AS tot FROM a)) GROUP BY ALL)
SELECT c.model_key, c.dataset_key, c.problem_idx, coalesce(n_wrong, 0) AS n_wrong, round(abs(coalesce(entropy, 0)), 8) AS entropy
FROM c LEFT JOIN b USING (model_key, dataset_key, problem_idx)""",
)
def answer_breadth(spark, d):
    out = C.answer_breadth(trimmed(spark, d), F.col("answer"), F.col("correct"))
    return out.select("model_key", "dataset_key", "problem_idx", "n_wrong", F.round(F.abs("entropy"), 8).alias("entropy"))


_BOOT = f""", o AS (SELECT *, row_number() OVER (ORDER BY dataset_key, problem_idx) - 1 AS pos FROM p),
v AS (SELECT pos, k, {sql_pass_at_k('nb', 'cb', 'k')} AS vb, {sql_pass_at_k('nr', 'cr', 'k')} AS vr FROM o, ks WHERE k <= least(nb, nr)),
d AS (SELECT rep, ('0x' || substr(md5(rep || '|' || slot), 1, 15))::BIGINT % (SELECT count(*) FROM p) AS pos
      FROM (SELECT unnest(range({N_BOOT})) AS rep), (SELECT unnest(range((SELECT count(*) FROM p))) AS slot)),
x AS (SELECT rep, k, avg(vb) AS b, avg(vr) AS r FROM d JOIN v USING (pos) GROUP BY ALL)
"""


def draws(spark: SparkSession, of: DataFrame, n: int = N_BOOT) -> DataFrame:
    return B.hash_draws(spark, of.count(), n)


@query("bootstrap_gap", _BOOT + "SELECT k, round(base, 8) AS base, round(rl, 8) AS rl, round(base - rl, 8) AS gap, round(lo, 8) AS lo, round(hi, 8) AS hi FROM (SELECT k, avg(vb) AS base, avg(vr) AS rl FROM v GROUP BY k) JOIN (SELECT k, quantile_cont(b - r, 0.025) AS lo, quantile_cont(b - r, 0.975) AS hi FROM x GROUP BY k) USING (k)")
def bootstrap_gap(spark, d):
    p = pairs(spark, d).persist()
    return B.bootstrap_gap(p, draws(spark, p)).select("k", *(r(c) for c in ("base", "rl", "gap", "lo", "hi")))


@query("bootstrap_mean", _BOOT + "SELECT k, round(mean, 8) AS mean, round(lo, 8) AS lo, round(hi, 8) AS hi FROM (SELECT k, avg(vb) AS mean FROM v GROUP BY k) JOIN (SELECT k, quantile_cont(b, 0.025) AS lo, quantile_cont(b, 0.975) AS hi FROM x GROUP BY k) USING (k)")
def bootstrap_mean(spark, d):
    p = pairs(spark, d).persist()
    return B.bootstrap_mean(p, draws(spark, p)).select("k", *(r(c) for c in ("mean", "lo", "hi")))


@query("bootstrap_crossover", _BOOT + ", y AS (SELECT rep, min(k) FILTER (round(b, 12) >= round(r, 12)) AS k FROM x GROUP BY rep) SELECT round(count(k) / count(*), 8) AS p_exists, round(quantile_cont(k::DOUBLE, 0.025), 8) AS lo, round(quantile_cont(k::DOUBLE, 0.5), 8) AS median, round(quantile_cont(k::DOUBLE, 0.975), 8) AS hi FROM y")
def bootstrap_crossover(spark, d):
    p = pairs(spark, d).persist()
    return B.bootstrap_crossover(p, draws(spark, p)).select(*(r(c) for c in ("p_exists", "lo", "median", "hi")))


@query("crossover_k", f", y AS (SELECT k, round(avg({sql_pass_at_k('n', 'c', 'k')}) FILTER (model_key = 'base'), 12) AS b, round(avg({sql_pass_at_k('n', 'c', 'k')}) FILTER (model_key = 'rl'), 12) AS r FROM c, ks WHERE k <= n GROUP BY k) SELECT min(k) FILTER (b >= r)::INT AS k_star FROM y")
def crossover_k(spark, d):
    return C.crossover(C.curve(counts(spark, d)))


@query("iso_compute", f", m AS (SELECT model_key, avg(n_completion_tokens) AS mt FROM t GROUP BY model_key) SELECT model_key, k, round(k * mt, 6) AS compute, round(avg({sql_pass_at_k('n', 'c', 'k')}), 8) AS pass_at_k FROM c JOIN m USING (model_key), ks WHERE k <= n GROUP BY ALL")
def iso_compute(spark, d):
    t = trimmed(spark, d)
    tokens = t.groupBy("model_key").agg(F.avg("n_completion_tokens").alias("mean_tokens"))
    return C.iso_compute(C.curve(X.dense_counts(t, F.col("correct"))), tokens).select("model_key", "k", r("compute", 6), r("pass_at_k"))


@query("nullgold_rate", "SELECT model_key, round(avg(nullgold::INT), 8) AS phi, round(avg((answer_token_pos < 0)::INT), 8) AS no_answer_rate, round(avg(n_completion_tokens), 8) AS mean_tokens FROM t GROUP BY ALL")
def nullgold_rate(spark, d):
    mean = lambda c: F.round(F.avg(c), 8)
    return trimmed(spark, d).groupBy("model_key").agg(mean(F.col("nullgold").cast("int")).alias("phi"), mean((F.col("answer_token_pos") < 0).cast("int")).alias("no_answer_rate"), mean("n_completion_tokens").alias("mean_tokens"))


@query("phi_correction", ", f AS (SELECT model_key, dataset_key, problem_idx, avg(correct::INT) AS o, avg(nullgold::INT) AS phi FROM t GROUP BY ALL) SELECT model_key, dataset_key, problem_idx, round(greatest(0, least(1, (o - phi) / (1 - phi))), 8) AS rate FROM f")
def phi_correction(spark, d):
    f = trimmed(spark, d).groupBy("model_key", "dataset_key", "problem_idx").agg(F.avg(F.col("correct").cast("int")).alias("o"), F.avg(F.col("nullgold").cast("int")).alias("phi"))
    return f.select("model_key", "dataset_key", "problem_idx", F.round(corrected_rate(F.col("o"), F.col("phi")), 8).alias("rate"))


@query("budget_ladder", ", b AS (SELECT unnest([0, 100, 250, 500, 1000, 1500]) AS budget) SELECT model_key, budget, round(avg((correct AND answer_token_pos >= 0 AND answer_token_pos <= budget)::INT), 8) AS rate FROM t, b GROUP BY ALL")
def budget_ladder(spark, d):
    ladder = [0, 100, 250, 500, 1000, 1500]
    hit = lambda b: F.avg(at_budget(F.col("correct"), F.col("answer_token_pos"), F.lit(b)).cast("int"))
    wide = trimmed(spark, d).groupBy("model_key").agg(*(hit(b).alias(f"b{b}") for b in ladder))
    return wide.select("model_key", F.explode(F.array(*(F.struct(F.lit(b).alias("budget"), F.round(f"b{b}", 8).alias("rate")) for b in ladder))).alias("x")).select("model_key", "x.*")


# The lattice, written out by subset: an independent form of the 32-sum plan.
_CELL = f""", bud AS (
  SELECT coalesce(max(answer_token_pos) FILTER (model_key = 'base' AND answer_token_pos >= 0), 0) AS budget,
         avg(n_completion_tokens) FILTER (model_key = 'base') AS tb, avg(n_completion_tokens) FILTER (model_key = 'rl') AS tr, max(n) AS n FROM t),
mk AS (SELECT unnest(range(64))::INT AS mask),
pm AS (
  SELECT dataset_key, problem_idx, mask, any_value(t.n) AS n, max(release_date) AS rd,
         count(*) FILTER (model_key = 'base' AND correct) AS c0,
         count(*) FILTER (model_key = 'base' AND ok) AS cb, count(*) FILTER (model_key = 'rl' AND ok) AS cr
  FROM (SELECT t.*, mask, (CASE WHEN mask & 32 > 0 THEN alt_correct ELSE correct END)
               AND (mask & 4 = 0 OR NOT nullgold)
               AND (mask & 8 = 0 OR (answer_token_pos >= 0 AND answer_token_pos <= budget)) AS ok
        FROM t, mk, bud) t GROUP BY ALL),
pw AS (
  SELECT pm.*, CASE WHEN mask & 1 > 0 AND NOT (c0 / pm.n BETWEEN 0.05 AND 0.80) THEN 0.0 ELSE 1.0 END
             * CASE WHEN mask & 2 > 0 AND NOT rd > DATE '2025-12-01' THEN 0.0 ELSE 1.0 END AS w,
         least(16, pm.n) AS kb,
         CASE WHEN mask & 16 > 0 THEN greatest(1, least(pm.n, floor(least(16, pm.n) * tb / tr)))::BIGINT ELSE least(16, pm.n) END AS kr
  FROM pm, bud),
gm AS (SELECT mask, sum(w * {sql_pass_at_k('n', 'cb', 'kb')}) / sum(w) - sum(w * {sql_pass_at_k('n', 'cr', 'kr')}) / sum(w) AS g FROM pw WHERE w > 0 GROUP BY mask),
pl AS (SELECT unnest(range(6))::INT AS i, unnest(['C2', 'C3', 'C4', 'C5', 'C6', 'C7']) AS confound),
sh AS (
  SELECT confound, sum(wt * (a.g - b.g)) AS shapley, max(a.g - b.g) FILTER (a.mask = 63 - (1 << i)) AS loo
  FROM (SELECT pl.*, gm.mask, gm.g, [1/6::DOUBLE, 1/30::DOUBLE, 1/60::DOUBLE, 1/60::DOUBLE, 1/30::DOUBLE, 1/6::DOUBLE][bit_count(gm.mask) + 1] AS wt FROM pl, gm WHERE gm.mask & (1 << i) = 0) a
  JOIN gm b ON b.mask = a.mask + (1 << i) GROUP BY confound)
"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lattice(L.cell_sums(L.problem_states(trimmed(spark, sf_dir), SETTINGS)))


@query("lattice_gaps", _CELL + "SELECT mask, round(g, 8) AS g FROM gm")
def lattice_gaps(spark, d):
    return gaps(spark, d).select("mask", r("g"))


@query("shapley", _CELL + "SELECT confound, round(shapley, 8) AS shapley FROM sh")
def shapley(spark, d):
    return L.shapley(gaps(spark, d)).select("confound", r("shapley"))


@query("loo", _CELL + "SELECT confound, round(loo, 8) AS loo FROM sh")
def loo(spark, d):
    return L.shapley(gaps(spark, d)).select("confound", r("loo"))


@query(
    "decomposition",
    _CELL + """SELECT confound, round(shapley, 8) AS shapley, round(shapley / (SELECT g FROM gm WHERE mask = 0), 6) AS share, round(loo, 8) AS loo
FROM (SELECT * FROM sh UNION ALL SELECT 'C1', g, NULL FROM gm WHERE mask = 63)""",
)
def decomposition(spark, d):
    return L.decomposition(gaps(spark, d)).select("confound", r("shapley"), r("share", 6), r("loo"))


@query("waterfall", _CELL + "SELECT confound, round(shapley, 8) AS shapley, round((SELECT g FROM gm WHERE mask = 0) - sum(shapley) OVER (ORDER BY confound ROWS UNBOUNDED PRECEDING), 8) AS running FROM sh")
def waterfall(spark, d):
    return L.waterfall(L.decomposition(gaps(spark, d))).select("confound", r("shapley"), r("running"))


def _single(i: int, name: str):
    @query(f"gap_{name.lower()}", _CELL + f"SELECT '{name}' AS confound, round((SELECT g FROM gm WHERE mask = 0), 8) AS raw_gap, round(g, 8) AS gap FROM gm WHERE mask = {1 << i}")
    def single(spark, d):
        at = lambda m: F.round(F.max(F.when(F.col("mask") == m, F.col("g"))), 8)
        return L.require_strata(gaps(spark, d)).agg(at(0).alias("raw_gap"), at(1 << i).alias("gap")).select(F.lit(name).alias("confound"), "raw_gap", "gap")


for _i, _name in enumerate(L.CONFOUNDS):
    _single(_i, _name)


@query(
    "bootstrap_shapley",
    f""", o AS (SELECT dataset_key, problem_idx, row_number() OVER (ORDER BY dataset_key, problem_idx) - 1 AS pos FROM p),
f AS (SELECT pos, coalesce(max(answer_token_pos) FILTER (model_key = 'base' AND answer_token_pos >= 0), 0) AS last_, avg(n_completion_tokens) FILTER (model_key = 'base') AS tb, avg(n_completion_tokens) FILTER (model_key = 'rl') AS tr FROM t JOIN o USING (dataset_key, problem_idx) GROUP BY pos),
d AS (SELECT rep, ('0x' || substr(md5(rep || '|' || slot), 1, 15))::BIGINT % (SELECT count(*) FROM p) AS pos FROM (SELECT unnest(range({N_BOOT_LATTICE})) AS rep), (SELECT unnest(range((SELECT count(*) FROM p))) AS slot)),
rb AS (SELECT rep, max(last_) AS budget, avg(tb) AS tb, avg(tr) AS tr FROM d JOIN f USING (pos) GROUP BY rep),
mk AS (SELECT unnest(range(8))::INT AS cm),
pm AS (
  SELECT pos, budget, cm, any_value(n) AS n, max(release_date) AS rd, count(*) FILTER (model_key = 'base' AND correct) AS c0,
         count(*) FILTER (model_key = 'base' AND ok) AS cb, count(*) FILTER (model_key = 'rl' AND ok) AS cr
  FROM (SELECT t.*, o.pos, b.budget, cm, (CASE WHEN cm & 1 > 0 THEN alt_correct ELSE correct END) AND (cm & 2 = 0 OR NOT nullgold) AND (cm & 4 = 0 OR (answer_token_pos >= 0 AND answer_token_pos <= budget)) AS ok
        FROM t JOIN o USING (dataset_key, problem_idx), (SELECT DISTINCT budget FROM rb) b, mk) GROUP BY ALL),
m64 AS (SELECT unnest(range(64))::INT AS mask),
z AS (
  SELECT d.rep, mask, pm.n, cb, cr, CASE WHEN mask & 1 > 0 AND NOT (c0 / pm.n BETWEEN 0.05 AND 0.80) THEN 0.0 ELSE 1.0 END * CASE WHEN mask & 2 > 0 AND NOT rd > DATE '2025-12-01' THEN 0.0 ELSE 1.0 END AS w,
         least(16, pm.n) AS kb, CASE WHEN mask & 16 > 0 THEN greatest(1, least(pm.n, floor(least(16, pm.n) * tb / tr)))::BIGINT ELSE least(16, pm.n) END AS kr
  FROM d JOIN rb USING (rep) JOIN pm ON pm.pos = d.pos AND pm.budget = rb.budget
  JOIN m64 ON pm.cm = (mask & 32) // 32 + 2 * ((mask & 4) // 4) + 4 * ((mask & 8) // 8)),
gm AS (SELECT rep, mask, sum(w * {sql_pass_at_k('n', 'cb', 'kb')}) / sum(w) - sum(w * {sql_pass_at_k('n', 'cr', 'kr')}) / sum(w) AS g FROM z WHERE w > 0 GROUP BY ALL),
pl AS (SELECT unnest(range(6))::INT AS i, unnest(['C2', 'C3', 'C4', 'C5', 'C6', 'C7']) AS confound),
sh AS (
  SELECT a.rep, confound, sum([1/6::DOUBLE, 1/30::DOUBLE, 1/60::DOUBLE, 1/60::DOUBLE, 1/30::DOUBLE, 1/6::DOUBLE][bit_count(a.mask) + 1] * (a.g - b.g)) AS phi
  FROM (SELECT * FROM pl, gm WHERE gm.mask & (1 << i) = 0) a JOIN gm b ON b.rep = a.rep AND b.mask = a.mask + (1 << i) GROUP BY ALL)
SELECT confound, round(quantile_cont(phi, 0.025), 8) AS lo, round(quantile_cont(phi, 0.975), 8) AS hi, count(*) AS n_boot_ok
FROM sh WHERE rep IN (SELECT rep FROM gm GROUP BY rep HAVING count(*) = 64) GROUP BY confound""",
)
def bootstrap_shapley(spark, d):
    t = trimmed(spark, d).persist()
    n = t.select("dataset_key", "problem_idx").distinct()
    return L.bootstrap_shapley(t, draws(spark, n, N_BOOT_LATTICE), SETTINGS).select("confound", r("lo"), r("hi"), "n_boot_ok")
