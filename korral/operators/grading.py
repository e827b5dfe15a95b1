"""Grading as one wide projection: every grader by every extraction policy, against gold and null gold."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korral.functions import text as T

class Grader(NamedTuple):
    """A grader as columns: ``form`` reads an answer, gold ones once per problem; ``same`` compares two forms.

    ``same`` is null where a prediction can't be graded: it counts as wrong and the sample's status is ``error``.
    """

    form: Callable[[Column], Column]
    same: Callable[[Column, Column], Column]


def fastint(gold: Column, pred: Column) -> Column:
    """Equal as integers of any length; false where either is none."""
    return _equal(T.as_int(gold), T.as_int(pred))


def _equal(gold: Column, pred: Column) -> Column:
    return F.coalesce(gold == pred, F.lit(False))


#: Graders by name. Others can be registered, with Arrow UDFs too.
GRADERS: dict[str, Grader] = {"fastint": Grader(T.as_int, _equal)}


def available_graders() -> tuple[str, ...]:
    return tuple(sorted(GRADERS))


def grade(samples: DataFrame, problems: DataFrame, nullgold: DataFrame, graders: tuple[str, ...] = ("fastint",), policies: tuple[str, ...] = T.POLICIES) -> DataFrame:
    """Samples with their extractions, grades and measures of the text's tail; one map-side pass but for the join with the problems.

    ``problems`` (dataset_key, problem_idx, answer) and ``nullgold`` (.., null_answer) are small dimensions, joined
    with each other first; Spark broadcasts them by their size.
    """
    if unknown := sorted(set(graders) - set(GRADERS)):
        raise ValueError(f"unknown graders {unknown}; available: {available_graders()}")
    key = ["dataset_key", "problem_idx"]
    forms = [GRADERS[g].form(F.col(c)).alias(f"{c}__{g}_") for g in graders for c in ("gold", "null_answer")]
    golds = problems.select(*key, F.col("answer").alias("gold")).join(nullgold.select(*key, "null_answer"), key).select(*key, "gold", *forms)
    rows = samples.join(golds, key).withColumn("tail_", T.tail(F.col("text"))).withColumn("x_", T.extract_all(F.col("tail_")))
    start = T.find_last(F.col("tail_"), F.coalesce("x_.boxed_last", "x_.boxed_strict"))
    rows = rows.withColumns({f"extracted__{p}": F.col("x_")[p] for p in policies} | {"answer_token_pos": T.answer_token_pos(F.col("tail_"), start, F.col("n_completion_tokens")), "n_distinct_ints": T.n_distinct_ints(F.col("tail_")), "repetition_ratio": T.repetition_ratio(F.col("tail_"))})
    rows = rows.withColumns({f"pred__{g}__{p}_": GRADERS[g].form(F.col(f"extracted__{p}")) for g in graders for p in policies})
    graded = {}
    for g in graders:
        failed = F.lit(False)
        for p in policies:
            got, pred = F.col(f"extracted__{p}").isNotNull(), F.col(f"pred__{g}__{p}_")
            hit, null_hit = (GRADERS[g].same(F.col(f"{c}__{g}_"), pred) for c in ("gold", "null_answer"))
            bad = got & (hit.isNull() | null_hit.isNull())
            graded[f"correct__{g}__{p}"], graded[f"nullgold__{g}__{p}"] = (F.coalesce(got & ~bad & x, F.lit(False)) for x in (hit, null_hit))
            failed = failed | bad
        graded[f"grade_status__{g}"] = F.when(failed, "error").otherwise("ok")
    rows = rows.withColumns(graded)
    return rows.drop("tail_", "x_", *(c for c in rows.columns if c.endswith("_") and c.startswith(("gold__", "null_answer__", "pred__"))))


def derangement(n: int, seed: int = 0, tries: int = 1000) -> list[int]:
    """A permutation without fixed points: the first seeded one found, else a rotation by one."""
    if n < 2:
        raise ValueError("one problem alone has no other's answer")
    rng = np.random.default_rng(seed)
    for _ in range(tries):
        p = rng.permutation(n)
        if not (p == np.arange(n)).any():
            return p.tolist()
    return [(i + 1) % n for i in range(n)]


def permuted_golds(problems: DataFrame, seed: int | None = None) -> DataFrame:
    """(dataset_key, problem_idx, null_answer): each problem with another one's answer.

    A dataset of one problem is an error. Without a seed the answers rotate by one within the dataset (a join on the position, no list on the
    driver); with one, the problems, a manifest's worth, are permuted on the driver.
    """
    from pyspark.sql import Window as W

    by = W.partitionBy("dataset_key").orderBy("problem_idx")
    rows = problems.select("dataset_key", "problem_idx", "answer")
    if seed is None:
        first = F.first("answer").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        alone = F.count("*").over(W.partitionBy("dataset_key")) < 2
        other = F.when(alone, F.raise_error(F.concat(F.lit("one problem alone has no other's answer: "), "dataset_key")).cast("string"))
        return rows.select("dataset_key", "problem_idx", other.otherwise(F.coalesce(F.lead("answer").over(by), first)).alias("null_answer"))
    out = []
    golds: dict[str, list] = {}
    for r in rows.orderBy("dataset_key", "problem_idx").collect():
        golds.setdefault(r.dataset_key, []).append(r)
    for key, own in golds.items():
        out += [(key, r.problem_idx, own[j].answer) for r, j in zip(own, derangement(len(own), seed), strict=True)]
    return problems.sparkSession.createDataFrame(out, "dataset_key string, problem_idx bigint, null_answer string")
