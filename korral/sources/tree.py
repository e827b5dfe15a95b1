"""The artifact tree: immutable shards, certified by completion markers that are written last.

Shards are read as Parquet or as zstd-JSONL (which Spark reads but can't write).
A reader trusts markers, not directory listings: data without a marker is
ignored, and a marker without data is an error or dropped, as asked.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER_SCHEMA = 3
MARKERS = (
    "unit_id string, schema int, n_rows bigint, sha256 string, bytes bigint, problem_idxs array<int>, seed_lo bigint, seed_hi bigint, "
    "chunk_size int, engine_fingerprint string, git_sha string, wall_s double, started_at string, finished_at string"
)
SAMPLES = (
    "sample_uid string, exp_id string, model_key string, model_revision string, dataset_key string, problem_idx bigint, problem_uid string, variant string, "
    "prompt_sha string, sampling_id string, sample_idx bigint, seed bigint, n_prompt_tokens bigint, max_tokens_effective bigint, text string, "
    "n_completion_tokens bigint, finish_reason string, stop_str string"
)
PROBLEMS = ("problem_idx bigint, problem_uid string, dataset_key string, question string, answer string, release_date date, answer_type string")
PLAN = (
    "unit_id string, exp_id string, model_key string, dataset_key string, variant string, sampling_id string, pshard bigint, chunk_idx bigint, "
    "problem_idxs array<bigint>, sample_lo bigint, sample_hi bigint, n_total bigint, chunk_size bigint"
)

_UNIT = "exp={exp}/model={model}/ds={dataset}/var={variant}/samp={sampling}/pshard={pshard:02d}/chunk={chunk:04d}"
_PARSE = re.compile(r"exp=(?P<exp>[^/]+)(?:/gradecfg=(?P<gradecfg>[^/]+))?/model=(?P<model>[^/]+)/ds=(?P<dataset>[^/]+)/var=(?P<variant>[^/]+)/samp=(?P<sampling>[^/]+)/pshard=(?P<pshard>\d+)/chunk=(?P<chunk>\d+)")


def sample_path(root: str, **unit) -> str:
    return f"{root}/gen/" + _UNIT.format(**unit)


def grade_path(root: str, gradecfg: str, **unit) -> str:
    return f"{root}/graded/" + _UNIT.format(**unit).replace("/model=", f"/gradecfg={gradecfg}/model=", 1)


def marker_path(path: str) -> str:
    return f"{path}.done.json"


def parse_path(path: str) -> dict:
    """The unit that a path was built from."""
    m = _PARSE.search(path)
    if m is None:
        raise ValueError(f"not a shard path: {path}")
    out = {k: v for k, v in m.groupdict().items() if v is not None}
    return out | {"pshard": int(out["pshard"]), "chunk": int(out["chunk"])}


def path_columns(path) -> list:
    """The same as columns, for ``_metadata.file_path``."""
    names = ("exp", "model", "ds", "var", "samp", "pshard", "chunk")
    return [F.regexp_extract(path, rf"/{n}=([^/.]+)", 1).alias(n) for n in names]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small file in the tree's own file system: written beside its place, then renamed."""
    fs, p = _fs(spark, path)
    if fs.exists(p) and not replace:
        raise FileExistsError(path)
    _, tmp = _fs(spark, path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"could not rename to {path}")


def sweep_tmp(spark: SparkSession, root: str) -> int:
    """Delete what interrupted writers left behind."""
    fs, p = _fs(spark, root)
    n = 0
    if fs.exists(p):
        found = fs.listFiles(p, True)
        old = []
        while found.hasNext():
            at = found.next().getPath()
            if at.getName().endswith(".tmp"):
                old.append(at)
        n = sum(bool(fs.delete(at, False)) for at in old)
    return n


def write_shard(df: DataFrame, path: str) -> dict:
    """An immutable Parquet (zstd) shard; refuses where a marker certifies one already, and empty ones."""
    spark = df.sparkSession
    if exists(spark, marker_path(path)):
        raise FileExistsError(f"certified already: {path}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    facts = spark.read.parquet(path).agg(F.count("*").alias("n")).first()
    if not facts.n:
        raise ValueError(f"empty shard: {path}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    sums = files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("content", 256))), "\n"), 256).alias("s"), F.sum("length").alias("b")).first()
    return {"n_rows": facts.n, "sha256": sums.s, "bytes": sums.b}


def write_marker(spark: SparkSession, path: str, unit_id: str, facts: dict, **more) -> dict:
    """Certify a shard, last of all; refuses if its data isn't there."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    now = datetime.now(timezone.utc).isoformat()
    row = {"unit_id": unit_id, "schema": MARKER_SCHEMA, "started_at": now, "finished_at": now} | facts | more
    write_text(spark, marker_path(path), json.dumps(row, sort_keys=True))
    return row


def read_markers(spark: SparkSession, root: str) -> DataFrame:
    """All markers under a root, with the data path that each certifies."""
    rows = spark.read.schema(MARKERS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.done.json").json(root)
    rows = rows.select("*", F.regexp_replace(F.col("_metadata.file_path"), r"\.done\.json$", "").alias("data_path"))
    return rows.withColumn("schema", F.when(F.col("schema") == MARKER_SCHEMA, F.col("schema")).otherwise(F.raise_error(F.concat(F.lit("marker of another schema: "), F.col("data_path"))).cast("int")))


def verify_shard(spark: SparkSession, path: str, sha256: str, n_rows: int) -> bool:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    got = files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("content", 256))), "\n"), 256).alias("s")).first().s
    return got == sha256 and spark.read.parquet(path).count() == n_rows


def read_samples(spark: SparkSession, root: str) -> DataFrame:
    """zstd-JSONL (or plain JSONL) sample shards under a root."""
    return spark.read.schema(SAMPLES).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").json(root)


def list_gradecfgs(spark: SparkSession, root: str, exp: str) -> list[str]:
    fs, p = _fs(spark, f"{root}/graded/exp={exp}")
    return sorted(s.getPath().getName().removeprefix("gradecfg=") for s in fs.listStatus(p) if s.getPath().getName().startswith("gradecfg=")) if fs.exists(p) else []


def load_graded(spark: SparkSession, root: str, exp: str, gradecfg: str | None = None) -> tuple[DataFrame, str]:
    """The graded rows of exactly one grading configuration, chosen by marker; a repeated sample_uid is an error."""
    found = list_gradecfgs(spark, root, exp)
    if gradecfg is None:
        if len(found) != 1:
            raise ValueError(f"{len(found)} grading configurations {found}: choose one")
        gradecfg = found[0]
    base = f"{root}/graded/exp={exp}/gradecfg={gradecfg}"
    if gradecfg not in found:
        raise FileNotFoundError(base)
    paths = [r.data_path for r in read_markers(spark, base).select("data_path").toLocalIterator()]
    paths = [p for p in paths if exists(spark, p)]
    if not paths:
        raise FileNotFoundError(f"no certified grading under {base}")
    df = spark.read.parquet(*paths)
    once = df.groupBy("sample_uid").agg(F.count("*").alias("m")).where("m > 1").limit(3).collect()
    if once:
        raise ValueError(f"repeated sample_uid, e.g. {[r.sample_uid for r in once]}")
    return df, gradecfg


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """A problem manifest (JSONL): every question's hash must match, and positions be dense from 0."""
    from korral.functions.ids import content_sha
    from korral.functions.text import normalize_question

    df = spark.read.schema(PROBLEMS).option("mode", "FAILFAST").json(path)
    ok = F.col("problem_uid") == content_sha(normalize_question(F.col("question")))
    df = df.withColumn("problem_uid", F.when(ok, F.col("problem_uid")).otherwise(F.raise_error(F.concat(F.lit("drifted problem "), F.col("problem_idx").cast("string")))))
    bad = df.groupBy("dataset_key").agg(F.count("*").alias("n"), F.count_distinct("problem_idx").alias("d"), F.max("problem_idx").alias("m"), F.min("problem_idx").alias("l")).where("n <> d or m <> n - 1 or l <> 0").collect()
    if bad:
        raise ValueError(f"positions aren't dense: {[r.dataset_key for r in bad]}")
    return df


def write_problems(df: DataFrame, path: str) -> None:
    """A manifest in order, as one JSONL file (a manifest's worth of rows)."""
    df.select(*(f.split()[0] for f in PROBLEMS.split(", "))).coalesce(1).sortWithinPartitions("dataset_key", "problem_idx").write.mode("errorifexists").json(path)


def load_problems(df: DataFrame, dataset_key: str, order: str, question: tuple[str, ...] = ("problem", "question", "prompt"), answer: tuple[str, ...] = ("answer", "final_answer", "solution"), release_date: str | None = None, answer_type: str = "integer") -> DataFrame:
    """Problems from a raw dataset: the first field that is filled, normalised, numbered by an explicit order."""
    from pyspark.sql import Window as W

    from korral.functions.ids import content_sha
    from korral.functions.text import normalize_answer, normalize_question

    def pick(names: tuple[str, ...]):
        have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*have, F.raise_error(F.lit(f"none of {names} is filled")))

    q = pick(question)
    rows = df.select((F.row_number().over(W.orderBy(order)) - 1).cast("bigint").alias("problem_idx"), content_sha(normalize_question(q)).alias("problem_uid"), F.lit(dataset_key).alias("dataset_key"), q.alias("question"), normalize_answer(pick(answer)).alias("answer"))
    return rows.withColumn("release_date", F.lit(release_date).cast("date")).withColumn("answer_type", F.lit(answer_type))


def publish(spark: SparkSession, source: str, target: str, skip: Iterator[str] = ()) -> int:
    """Copy a tree to another file system in two passes: data first, then the markers seen before the first pass."""
    fs, p = _fs(spark, source)
    out, _ = _fs(spark, target)
    util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found, paths = fs.listFiles(p, True), []
    while found.hasNext():
        paths.append(found.next().getPath())
    top = fs.makeQualified(p).toString().rstrip("/")
    n = 0
    for marked in (False, True):
        for at in paths:
            name = at.toString().removeprefix(top)
            if at.getName().endswith(".tmp") or at.getName().endswith(".done.json") != marked:
                continue
            _, to = _fs(spark, target + name)
            if not out.exists(to):
                n += bool(util.copy(fs, at, out, to, False, conf))
    return n


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; in a single process without one, a temporary folder of its own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where or os.path.join(tempfile.gettempdir(), "korral-checkpoints")
