"""The integrity gate: every check is a query of violating rows (check, severity, arm, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korral.operators import planning

ARM = ("model_key", "dataset_key", "variant", "sampling_id")


def _rows(df: DataFrame, check: str, severity: str, arm: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), arm.alias("arm"), detail.alias("detail"))


def _arm() -> Column:
    return F.concat_ws("/", *ARM)


def incomplete(plan: DataFrame, markers: DataFrame, require: bool = True) -> DataFrame:
    return _rows(planning.remaining(plan, markers), "incomplete", "error" if require else "warning", _arm(), F.col("unit_id"))


def orphan_markers(plan: DataFrame, markers: DataFrame) -> DataFrame:
    return _rows(planning.orphans(plan, markers), "orphan_marker", "error", F.lit(""), F.col("unit_id"))


def bad_marker_schema(markers: DataFrame, version: int = 3) -> DataFrame:
    return _rows(markers.where(F.col("schema").isNull() | (F.col("schema") != version)), "marker_schema", "error", F.lit(""), F.col("unit_id"))


def uncovered(plan: DataFrame, markers: DataFrame, graded: DataFrame, require: bool = True) -> DataFrame:
    """Done units that no grading of the target configuration covers (graded: chunk paths with marker and data)."""
    left = planning.done(plan, markers).join(graded.select("chunk_path").distinct(), "chunk_path", "left_anti")
    return _rows(left, "uncovered", "error" if require else "warning", _arm(), F.col("chunk_path"))


def coverage(plan: DataFrame, markers: DataFrame, graded: DataFrame) -> DataFrame:
    """Per grading configuration: how many done units it covers, of how many."""
    finished = planning.done(plan, markers).select("chunk_path").distinct()
    n = finished.agg(F.count("*").alias("n_done"))
    return graded.select("gradecfg", "chunk_path").distinct().join(finished, "chunk_path").groupBy("gradecfg").agg(F.count("*").alias("n_covered")).crossJoin(F.broadcast(n))


def duplicate_seeds(samples: DataFrame) -> DataFrame:
    dup = samples.groupBy(*ARM, "seed").agg(F.count("*").alias("m")).where("m > 1")
    dup = dup.groupBy(*ARM).agg(F.count("*").alias("m"))
    return _rows(dup, "duplicate_seed", "error", _arm(), F.col("m").cast("string"))


def duplicate_uids(samples: DataFrame) -> DataFrame:
    dup = samples.groupBy("sample_uid").agg(F.count("*").alias("m")).where("m > 1")
    return _rows(dup, "duplicate_uid", "error", F.lit(""), F.col("sample_uid"))


def drifted_problems(samples: DataFrame) -> DataFrame:
    """Problems that come with more than one content hash."""
    drift = samples.groupBy("dataset_key", "problem_idx").agg(F.count_distinct("problem_uid").alias("m")).where("m > 1")
    return _rows(drift, "manifest_drift", "error", F.col("dataset_key"), F.col("problem_idx").cast("string"))


def _sizes(samples: DataFrame) -> DataFrame:
    each = samples.groupBy(*ARM, "problem_idx").agg(F.count("*").alias("m"))
    return each.groupBy(*ARM).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))


def ragged(samples: DataFrame) -> DataFrame:
    return _rows(_sizes(samples).where("lo < hi"), "ragged", "error", _arm(), F.concat_ws("..", "lo", "hi"))


def short_arms(samples: DataFrame, planned: DataFrame) -> DataFrame:
    """Arms with other sample counts than planned (planned: the arm's key and n_total)."""
    off = _sizes(samples).join(planned, list(ARM)).where("lo <> n_total or hi <> n_total")
    return _rows(off, "sample_count", "warning", _arm(), F.concat_ws(" of ", "hi", "n_total"))


def mixed_engines(markers: DataFrame) -> DataFrame:
    """Arms generated by more than one engine version (the fingerprint up to the first bar)."""
    mixed = markers.groupBy(*ARM).agg(F.count_distinct(F.substring_index("engine_fingerprint", "|", 1)).alias("m")).where("m > 1")
    return _rows(mixed, "engine_mix", "error", _arm(), F.col("m").cast("string"))


def ungraded(samples: DataFrame, graded: DataFrame, require: bool = True) -> DataFrame:
    """Certified samples that the chosen grading doesn't hold, by arm."""
    left = samples.join(graded.select("sample_uid").distinct(), "sample_uid", "left_anti").groupBy(*ARM).agg(F.count("*").alias("m"))
    return _rows(left, "ungraded", "error" if require else "warning", _arm(), F.col("m").cast("string"))


def missing(spark: SparkSession, check: str, detail: str) -> DataFrame:
    """One violation: something that every other check needs isn't there."""
    return spark.createDataFrame([(check, "error", "", detail)], "check string, severity string, arm string, detail string")


def corrupt_shards(files: DataFrame, rows: DataFrame, markers: DataFrame) -> DataFrame:
    """Shards whose bytes or row count don't match their marker (files: path, content; rows: path, a row per stored row; markers: data_path, sha256, n_rows)."""
    folder = lambda c: F.regexp_replace(F.regexp_replace(c, "/[^/]+$", ""), "^file:/+", "/")
    got = files.groupBy(folder(F.col("path")).alias("folder")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("content", 256))), "\n"), 256).alias("got"))
    count = rows.groupBy(folder(F.col("path")).alias("folder")).agg(F.count("*").alias("stored"))
    told = markers.select("data_path", folder(F.concat("data_path", F.lit("/x"))).alias("folder"), "sha256", "n_rows").distinct()
    bad = told.join(got, "folder", "left").join(count, "folder", "left").where("got is null or got <> sha256 or stored is null or stored <> n_rows")
    return _rows(bad, "checksum", "error", F.lit(""), F.col("data_path"))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def render(violations: DataFrame, limit: int = 3) -> tuple[bool, str]:
    """(passed, text): counts by check with a few examples each; warnings don't fail."""
    rows = violations.groupBy("check", "severity").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.concat_ws(" ", "arm", "detail"))), 1, limit).alias("eg")).orderBy("severity", "check").collect()
    ok = not any(r.severity == "error" for r in rows)
    lines = ["PASS" if ok else "FAIL"] + [f"{'ERROR' if r.severity == 'error' else 'WARN '} {r.check}: {r.n} (e.g. {'; '.join(r.eg)})" for r in rows]
    return ok, "\n".join(lines)
