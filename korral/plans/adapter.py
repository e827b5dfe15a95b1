"""A samples view derived from the star-schema tables, the same in Spark and in DuckDB.

``lineitem`` rows stand for graded samples: line status is the arm, supplier the
problem.  Only ANSI expressions, so both engines get the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korral.operators.tensor import truncated

#: Column expressions in SQL that both engines read alike.
COLUMNS = {
    "model_key": "CASE WHEN l_linestatus = 'F' THEN 'base' ELSE 'rl' END",
    "dataset_key": "concat('d', CAST(l_suppkey % 3 AS VARCHAR(9)))",
    "problem_idx": "CAST(floor(l_suppkey / 3) AS BIGINT)",
    "correct": "l_quantity <= l_suppkey % 50",
    "alt_correct": "l_quantity <= (l_suppkey % 50) + 2",
    "nullgold": "l_partkey % 20 = 0",
    "n_completion_tokens": "CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 2 * l_quantity END AS BIGINT)",
    "answer_token_pos": "CAST(CASE WHEN l_tax > 0.075 THEN -1 WHEN l_linestatus = 'F' THEN l_partkey % 1000 ELSE l_partkey % 1500 END AS BIGINT)",
    "release_month": "CAST(l_suppkey % 6 AS INT)",
    "answer": "CAST(l_partkey % 7 AS VARCHAR(9))",
}
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
KEY = ("model_key", "dataset_key", "problem_idx")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """All samples, numbered within each model and problem; ``more`` are raw columns to keep."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*(f"{e.replace('VARCHAR(9)', 'STRING')} AS {c}" for c, e in COLUMNS.items()), *dict.fromkeys((*ORDER, *more)))
    number = F.expr(f"row_number() OVER (PARTITION BY {', '.join(KEY)} ORDER BY {', '.join(ORDER)}) - 1").cast("bigint")
    rows = rows.withColumn("sample_idx", number)
    date = F.add_months(F.lit("2025-10-01").cast("date"), F.col("release_month"))
    return rows.withColumn("release_date", date).drop(*(c for c in ORDER if c not in more), "release_month")


def trimmed(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    # samples() numbers the rows, so a group has as many samples as rows.
    keys = (f"{COLUMNS[c].replace('VARCHAR(9)', 'STRING')} AS {c}" for c in KEY)
    sizes = table(spark, sf_dir, "lineitem").selectExpr(*keys).groupBy(*KEY).agg(F.count("*").alias("n_raw"))
    return truncated(samples(spark, sf_dir, *more), sizes=sizes)


#: The oracle's side: s all samples, t the truncated ones with n, c counts, p the paired counts.
SQL = f"""
WITH s AS (
  SELECT {', '.join(f'{e} AS {c}' for c, e in COLUMNS.items())}, {', '.join(ORDER)},
         (DATE '2025-10-01' + to_months(CAST(l_suppkey % 6 AS INT)))::DATE AS release_date,
         row_number() OVER (PARTITION BY {', '.join(COLUMNS[k] for k in KEY)} ORDER BY {', '.join(ORDER)}) - 1 AS sample_idx
  FROM lineitem),
g AS (SELECT model_key, dataset_key, problem_idx, count(*) AS n_raw FROM s GROUP BY ALL),
t AS (SELECT s.*, m.n FROM s, (SELECT min(n_raw) AS n FROM g) m WHERE sample_idx < m.n),
c AS (SELECT model_key, dataset_key, problem_idx, count(*) FILTER (correct) AS c, any_value(n) AS n FROM t GROUP BY ALL),
p AS (
  SELECT dataset_key, problem_idx, max(c) FILTER (model_key = 'base') AS cb, max(c) FILTER (model_key = 'rl') AS cr,
         max(n) FILTER (model_key = 'base') AS nb, max(n) FILTER (model_key = 'rl') AS nr
  FROM c GROUP BY ALL),
ks AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256]) AS k)
"""


def sql_pass_at_k(n: str, c: str, k: str) -> str:
    """The estimator as a product over a list, for DuckDB."""
    return f"(CASE WHEN {c} = 0 THEN 0.0 WHEN {n} - {c} < {k} THEN 1.0 ELSE 1.0 - list_aggregate(list_transform(range({n} - {c} + 1, {n} + 1), lambda i: 1.0::DOUBLE - {k}::DOUBLE / i), 'product') END)"


def sql_pass_at_k_gamma(n: str, c: str, k: str) -> str:
    """An independent form by log-gamma."""
    return f"(CASE WHEN {c} = 0 THEN 0.0 WHEN {n} - {c} < {k} THEN 1.0 ELSE 1.0 - exp(lgamma({n} - {c} + 1) + lgamma({n} - {k} + 1) - lgamma({n} - {c} - {k} + 1) - lgamma({n} + 1)) END)"
