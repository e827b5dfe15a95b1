"""Registries of models and datasets, and experiment configurations, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korral.functions.ids import index_hash, sampling_id

MODELS = "key string, seed_idx int, hf_id string, revision string, family string, role string, base_of string, rl_step int, native_context_len int, context_len int, rope_scaling map<string,string>, release_date date, prompt_variants array<string>, stop array<string>, dtype string"
DATASETS = "key string, seed_idx int, hf_path string, hf_config string, split string, revision string, tier string, release_date date, answer_type string, expected_rows int"


def registry(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A registry as a small DataFrame; an unknown field is an error."""
    names = [f.split()[0] for f in schema.replace("<string,string>", "<>").split(", ")]
    for r in rows:
        if extra := set(r) - set(names):
            raise ValueError(f"unknown fields {sorted(extra)}")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def repeated(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("m")).where("m > 1")


def dangling_bases(models: DataFrame) -> DataFrame:
    """Models whose base isn't registered."""
    keys = models.select(F.col("key").alias("base_of")).distinct()
    return models.where("base_of is not null").join(keys, "base_of", "left_anti")


def invalid_models(models: DataFrame) -> DataFrame:
    """(key, problem): longer context without rope scaling, no base, no step, seed index out of range."""
    rules = {
        "context beyond native without rope_scaling": "context_len > native_context_len and rope_scaling is null",
        "no base_of": "role <> 'base' and base_of is null",
        "no rl_step": "role = 'rl_ckpt' and rl_step is null",
        "seed_idx out of range": "seed_idx < 0 or seed_idx >= 64",
    }
    found = F.array_compact(F.array(*(F.when(F.expr(e), F.lit(n)) for n, e in rules.items())))
    return models.select("key", F.explode(found).alias("problem"))


def check_registry(models: DataFrame, datasets: DataFrame) -> None:
    for df in (models, datasets):
        for c in ("key", "seed_idx"):
            if bad := repeated(df, c).limit(3).collect():
                raise ValueError(f"repeated {c}: {[r[0] for r in bad]}")
    if bad := dangling_bases(models).limit(3).collect():
        raise ValueError(f"unknown base of {[r.key for r in bad]}")
    if bad := invalid_models(models).limit(3).collect():
        raise ValueError(f"invalid models: {[(r.key, r.problem) for r in bad]}")


def freeze_hash(df: DataFrame) -> str:
    return index_hash([(r.key, r.seed_idx) for r in df.select("key", "seed_idx").collect()])


def check_freeze(df: DataFrame, committed: str) -> None:
    if (now := freeze_hash(df)) != committed:
        raise ValueError(f"registry changed since it was frozen: {now} is not {committed}")


def arms(spark: SparkSession, experiment: dict, models: DataFrame) -> DataFrame:
    """An experiment's arms with their sampling; arms are unique, chunks even, variants permitted."""
    rows = []
    for a in experiment["arms"]:
        s = experiment["sampling"] | (a.get("sampling_override") or {})
        if s["n_total"] % s["chunk_size"]:
            raise ValueError(f"n_total {s['n_total']} isn't a multiple of chunk_size {s['chunk_size']}")
        if not 0 < s["n_total"] <= 1 << 20:
            raise ValueError("n_total must be in 1..2^20")
        rows.append((experiment["exp_id"], a["model_key"], a["dataset_key"], a["variant"], sampling_id(s), s["n_total"], s["chunk_size"]))
    if len({r[1:5] for r in rows}) < len(rows):
        raise ValueError("arms repeat")
    df = spark.createDataFrame(rows, "exp_id string, model_key string, dataset_key string, variant string, sampling_id string, n_total bigint, chunk_size bigint")
    return df.join(models.select(F.col("key").alias("model_key"), "prompt_variants"), "model_key").withColumn("variant_ok", F.array_contains("prompt_variants", F.col("variant"))).drop("prompt_variants")
