"""Command line over an artifact tree: registry-freeze, registry-check, doctor, prepare, plan, generate (mock), grade, verify, analyze, figures."""

from __future__ import annotations

import argparse
import json
import platform
import subprocess
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korral.functions import ids
from korral.functions import text as T
from korral.operators import grading, mock, planning, verify
from korral.operators.report import Analysis
from korral.sources import registry, tree


def session() -> SparkSession:
    return SparkSession.builder.appName("korral").config("spark.sql.session.timeZone", "UTC").config("spark.sql.sources.partitionColumnTypeInference.enabled", "false").getOrCreate()


def load(spark: SparkSession, path: str) -> dict:
    """An experiment file (JSON): models, datasets, experiment, problems (path of the manifest)."""
    return json.loads("".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))


def make_plan(spark: SparkSession, config: dict) -> DataFrame:
    models, datasets = registry.registry(spark, config["models"], registry.MODELS), registry.registry(spark, config["datasets"], registry.DATASETS)
    registry.check_registry(models, datasets)
    problems = tree.read_problems(spark, config["problems"]).select("dataset_key", "problem_idx")
    return planning.build_plan(registry.arms(spark, config["experiment"], models), problems, config["experiment"]["n_workers"])


def seeded(reqs: DataFrame, config: dict) -> DataFrame:
    index = lambda rows: F.create_map(*(F.lit(x) for r in rows for x in (r["key"], r["seed_idx"])))
    epoch = config["experiment"]["sampling"].get("seed_epoch", 0)
    return reqs.withColumn("seed", ids.seed(epoch=F.lit(epoch), model_idx=index(config["models"])[F.col("model_key")], dataset_idx=index(config["datasets"])[F.col("dataset_key")], problem_idx=F.col("problem_idx"), sample_idx=F.col("sample_idx")))


COMMANDS = ("registry-freeze", "registry-check", "doctor", "prepare", "plan", "generate", "grade", "verify", "analyze", "figures")


def git_sha() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="korral")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--config", required=True)
    p.add_argument("--root", required=True)
    p.add_argument("--base", default="base")
    p.add_argument("--rl", default="rl")
    p.add_argument("--policy", default="boxed_last")
    p.add_argument("--grader", default="fastint")
    p.add_argument("--graders", default="fastint", help="comma-separated; they name the grading configuration")
    p.add_argument("--gradecfg", default="", help="a grading configuration by its id; else the one of --graders")
    p.add_argument("--deep", action="store_true", help="read every shard again and compare bytes and rows with its marker")
    p.add_argument("--require-complete", action="store_true", help="units that aren't done, or graded, are errors")
    p.add_argument("--n-boot", type=int, default=2000)
    p.add_argument("--out")
    return p


class Tree:
    """The folders and tables of one experiment."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace, config: dict) -> None:
        self.spark, self.root, self.exp = spark, a.root, config["experiment"]["exp_id"]
        self.graders = tuple(g.strip() for g in a.graders.split(",") if g.strip())
        self.gradecfg = a.gradecfg or ids.grading_id(self.graders, T.POLICIES)
        self.samples, self.plan = f"{a.root}/samples/exp={self.exp}", f"{a.root}/plan/exp={self.exp}"
        self.graded = f"{a.root}/graded/exp={self.exp}/gradecfg={self.gradecfg}"

    def certified(self) -> DataFrame:
        paths = tree.read_markers(self.spark, self.samples).select(F.regexp_replace("data_path", r"\.\d+$", "").alias("p")).distinct()
        return self.spark.read.parquet(*(r.p for r in paths.toLocalIterator()))


def integrity(t: Tree, deep: bool = False, complete: bool = False) -> tuple[bool, str]:
    """The integrity gate: (passed, report)."""
    if not tree.exists(t.spark, t.plan):
        return verify.render(verify.missing(t.spark, "no_plan", t.plan))
    plan = t.spark.read.parquet(t.plan)
    if not tree.exists(t.spark, t.samples):
        return verify.render(verify.missing(t.spark, "no_samples", t.samples))
    done, rows = tree.read_markers(t.spark, t.samples), t.certified()
    planned = plan.select(*verify.ARM, "n_total").distinct()
    engines = done.select("unit_id", "engine_fingerprint").join(plan.select("unit_id", *verify.ARM), "unit_id")
    checks = [verify.incomplete(plan, done, complete), verify.orphan_markers(plan, done), verify.duplicate_seeds(rows), verify.duplicate_uids(rows), verify.drifted_problems(rows), verify.ragged(rows), verify.short_arms(rows, planned), verify.mixed_engines(engines)]
    if t.gradecfg in tree.list_gradecfgs(t.spark, t.root, t.exp):
        checks.append(verify.ungraded(rows, tree.load_graded(t.spark, t.root, t.exp, t.gradecfg)[0], complete))
    else:
        checks.append(verify.missing(t.spark, "no_grading", t.graded))
    if deep:
        marks = done.select(F.regexp_replace("data_path", r"\.\d+$", "").alias("data_path"), "sha256", "n_rows").distinct()
        files = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(t.samples)
        checks.append(verify.corrupt_shards(files, rows.select(F.col("_metadata.file_path").alias("path")), marks))
    return verify.render(verify.report(checks))


def prepare(spark: SparkSession, config: dict) -> None:
    """The problem manifest of the raw datasets that the config names (``raw``: key to path, order and fields)."""
    expected = {d["key"]: d.get("expected_rows") for d in config["datasets"]}
    parts = []
    for key, raw in sorted(config["raw"].items()):
        df = tree.load_problems(spark.read.json(raw["path"]), key, raw["order"], release_date=raw.get("release_date"))
        n = df.count()
        if expected.get(key) and n != expected[key]:
            print(f"WARN {key}: {n} rows, the registry expects {expected[key]}")
        parts.append(df)
    tree.write_problems(reduce(DataFrame.unionByName, parts), config["problems"])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    config = load(spark, a.config)
    frozen = f"{a.root}/registry.freeze.json"
    if a.command.startswith("registry-"):
        now = {k: registry.registry(spark, config[k], s) for k, s in (("models", registry.MODELS), ("datasets", registry.DATASETS))}
        registry.check_registry(now["models"], now["datasets"])
        if a.command == "registry-freeze":
            tree.write_text(spark, frozen, json.dumps({k: registry.freeze_hash(df) for k, df in now.items()}, sort_keys=True), replace=True)
        else:
            for k, committed in load(spark, frozen).items():
                registry.check_freeze(now[k], committed)
        print("registry OK")
        return 0
    if a.command == "doctor":
        print(f"python {platform.python_version()}, spark {spark.version}, graders {', '.join(grading.available_graders())}, git {git_sha()}")
        tree.write_text(spark, f"{a.root}/.doctor", "ok", replace=True)
        return 0
    if a.command == "prepare":
        prepare(spark, config)
        return 0
    t = Tree(spark, a, config)
    if a.command == "plan":
        make_plan(spark, config).write.mode("overwrite").parquet(t.plan)
        return 0
    if a.command == "verify":
        ok, text = integrity(t, a.deep, a.require_complete)
        print(text)
        return 0 if ok else 1
    problems = tree.read_problems(spark, config["problems"])
    if a.command == "generate":
        done = tree.read_markers(spark, t.samples).select("unit_id") if tree.exists(spark, t.samples) else spark.createDataFrame([], "unit_id string")
        todo = planning.remaining(spark.read.parquet(t.plan), done)
        reqs = seeded(planning.requests(todo, problems.select("dataset_key", "problem_idx", "problem_uid", "question", "answer")), config)
        out = planning.generate(reqs, mock.backend(), mock.SCHEMA)
        units = todo.select("unit_id").collect()
        if units:
            path = f"{t.samples}/run={ids.index_hash([(r.unit_id, 0) for r in units])[:12]}"
            facts = tree.write_shard(out, path)
            made = {"schema": tree.MARKER_SCHEMA, "engine_fingerprint": ids.engine_fingerprint("mock"), "git_sha": git_sha()} | facts
            for i, r in enumerate(units):  # a marker per unit, over the run's one data folder
                tree.write_text(spark, f"{path}.{i:06d}.done.json", json.dumps({"unit_id": r.unit_id} | made))
        return 0
    if a.command == "grade":
        out = grading.grade(t.certified(), problems, grading.permuted_golds(problems, seed=0), t.graders)
        facts = tree.write_shard(out, f"{t.graded}/all")
        tree.write_marker(spark, f"{t.graded}/all", f"grade-{t.gradecfg}", facts, git_sha=git_sha())
        return 0
    ok, text = integrity(t)
    if not ok:
        print(text)
        return 1
    df, _ = tree.load_graded(spark, a.root, t.exp, t.gradecfg)
    df = df.join(problems.select("dataset_key", "problem_idx", "release_date"), ["dataset_key", "problem_idx"])
    df = df.withColumn("correct", F.col(f"correct__{a.grader}__{a.policy}")).withColumn("nullgold", F.col(f"nullgold__{a.grader}__{a.policy}"))
    Analysis(df, a.base, a.rl, a.n_boot, min(a.n_boot, 500), seed=0, expected=problems.select("dataset_key", "problem_idx")).write(a.out or f"{a.root}/report/exp={t.exp}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
