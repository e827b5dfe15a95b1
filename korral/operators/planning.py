"""Work planning: arms x problem shards x sample chunks, and what of it is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korral.functions import ids


def build_plan(arms: DataFrame, problems: DataFrame, n_workers: int) -> DataFrame:
    """Work units: a row per arm, non-empty problem shard (round robin) and chunk of samples.

    ``arms``: exp_id, model_key, dataset_key, variant, sampling_id, n_total, chunk_size, variant_ok.
    ``problems``: dataset_key, problem_idx.
    """
    arms = arms.withColumn("variant", F.when(F.col("variant_ok"), F.col("variant")).otherwise(F.raise_error(F.concat_ws(" ", "model_key", F.lit("has no variant"), "variant")))) if "variant_ok" in arms.columns else arms
    shards = problems.groupBy("dataset_key", F.pmod("problem_idx", F.lit(n_workers)).alias("pshard")).agg(F.sort_array(F.collect_list("problem_idx")).alias("problem_idxs"))
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_total") / F.col("chunk_size")) - 1))
    units = arms.drop("variant_ok").join(shards, "dataset_key").withColumn("chunk_idx", chunks)
    units = units.withColumn("sample_lo", F.col("chunk_idx") * F.col("chunk_size")).withColumn("sample_hi", F.col("sample_lo") + F.col("chunk_size"))
    return units.withColumn("unit_id", ids.unit_id(*(F.col(c) for c in ("exp_id", "model_key", "dataset_key", "variant", "sampling_id", "pshard", "sample_lo", "sample_hi"))))


def remaining(plan: DataFrame, markers: DataFrame, worker: int | None = None) -> DataFrame:
    """Units without a completion marker, of one worker's shard if given."""
    plan = plan if worker is None else plan.where(F.col("pshard") == worker)
    return plan.join(markers.select("unit_id").distinct(), "unit_id", "left_anti")


def done(plan: DataFrame, markers: DataFrame) -> DataFrame:
    return plan.join(markers.select("unit_id").distinct(), "unit_id", "left_semi")


def orphans(plan: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers of no planned unit."""
    return markers.join(plan.select("unit_id").distinct(), "unit_id", "left_anti")


def check_worker(worker: int, n_workers: int) -> None:
    if not 0 <= worker < n_workers:
        raise ValueError(f"worker {worker} outside 0..{n_workers - 1}")


def requests(units: DataFrame, problems: DataFrame) -> DataFrame:
    """A row per sample to generate, with its uid."""
    each = units.select("*", F.explode("problem_idxs").alias("problem_idx")).withColumn("sample_idx", F.explode(F.sequence("sample_lo", F.col("sample_hi") - 1)))
    each = each.join(problems, ["dataset_key", "problem_idx"])
    return each.withColumn("sample_uid", ids.sample_uid(*(F.col(c) for c in ("exp_id", "model_key", "dataset_key", "variant", "sampling_id", "problem_idx", "sample_idx"))))


def effective_max_tokens(max_new: str, context: str, prompt: str, max_prompt: str):
    """Tokens left for the completion; a prompt over its limit or no room left is an error."""
    room = F.least(F.col(max_new), F.col(context) - F.col(prompt))
    bad = (room <= 0) | (F.col(prompt) > F.col(max_prompt))
    return F.when(~bad, room).otherwise(F.raise_error(F.concat(F.lit("token budget: prompt of "), F.col(prompt).cast("string"))).cast("bigint"))


def generate(reqs: DataFrame, backend: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a generation backend over the requests in Arrow batches; a batch must give a sample per request.

    A failed task is retried by Spark and its output committed once, so there is no stealing of shards.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = backend(b)
            if sorted(out["sample_uid"]) != sorted(b["sample_uid"]):
                raise ValueError("the backend's samples don't match its requests")
            yield out

    return reqs.mapInPandas(run, schema)


def replay(reqs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Requests answered from a recorded corpus by request_id; a missing one is an error."""
    got = reqs.join(corpus.withColumn("found_", F.lit(True)), reqs["sample_uid"] == corpus["request_id"], "left").drop("request_id")
    return got.withColumn("text", F.when(F.col("found_"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no recorded sample for "), F.col("sample_uid"))))).drop("found_")
