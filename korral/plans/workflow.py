"""Queries and oracles of extraction, grading, identifiers, planning and integrity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korral.functions import ids
from korral.functions import text as T
from korral.operators import grading, planning, verify
from korral.plans.adapter import table
from korral.sources import tree
from korral.streaming import incremental

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


#: Completions written from lineitem rows, with boxed, stated and bare answers.
_TEXT = """concat('Step ', CAST(l_linenumber AS VARCHAR(9)), '. ', CASE CAST(l_partkey % 5 AS INT)
  WHEN 0 THEN concat('So we get \\boxed{', CAST(l_partkey % 1000 AS VARCHAR(9)), '}.')
  WHEN 1 THEN concat('The final answer is ', CAST(l_partkey % 1000 AS VARCHAR(9)), ' after ', CAST(l_suppkey AS VARCHAR(9)), ',', CAST(100 + l_linenumber AS VARCHAR(9)), ' steps.')
  WHEN 2 THEN concat('Either \\boxed{', CAST(l_suppkey AS VARCHAR(9)), '} or \\boxed{-', CAST(l_partkey % 90 AS VARCHAR(9)), '}')
  WHEN 3 THEN 'again and again and again and again and again and again and again and again and again and again and again and again'
  ELSE concat('cut off at \\boxed{', CAST(l_partkey AS VARCHAR(9))) END)"""
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    expr = _TEXT.replace("VARCHAR(9)", "STRING").replace("\\boxed", "\\\\boxed")
    return table(spark, sf_dir, "lineitem").selectExpr(*_KEYS.split(", "), "l_quantity", f"{expr} AS text")


_X = f"WITH x AS (SELECT {_KEYS}, l_quantity, {_TEXT} AS text FROM lineitem)\n"
_BOXES = r"regexp_extract_all(text, '\\boxed\{([^{}]*)\}', 1)"


def _extraction(policy: str, sql: str):
    @query(f"extract_{policy}", _X + f"SELECT {_KEYS}, {sql} AS answer FROM x")
    def run(spark, d):
        return completions(spark, d).select(*_KEYS.split(", "), T.extract(F.col("text"), policy).alias("answer"))


_extraction("boxed_strict", f"CASE WHEN len({_BOXES}) = 1 THEN nullif(trim({_BOXES}[1]), '') END")
_extraction("boxed_last", f"nullif(trim({_BOXES}[-1]), '')")
_extraction("last_int", r"replace(regexp_extract_all(text, '-?\d[\d,]*')[-1], ',', '')")
_extraction("answer_is", r"nullif(trim(replace(regexp_extract_all(text, '(?i)(?:final answer|answer)\s*(?:is|:)\s*\$?\\?\(?\s*(-?[\d,]+|[^\s.$]{1,40})', 1)[-1], ',', '')), '')")


@query("extract_last_int_documents", r"SELECT doc_id, replace(regexp_extract_all(text, '-?\d[\d,]*')[-1], ',', '') AS answer, len(list_distinct(regexp_extract_all(text, '-?\d+'))) AS n_ints FROM documents")
def extract_last_int_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.extract(F.col("text"), "last_int").alias("answer"), T.n_distinct_ints(F.col("text")).alias("n_ints"))


@query(
    "fastint_grade",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, gold = pred AS correct, pred FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 50)::VARCHAR AS gold,
         CASE l_suppkey % 4 WHEN 3 THEN NULL ELSE ltrim((l_partkey % 50)::VARCHAR, ' ') END AS pred FROM lineitem) WHERE pred IS NOT NULL
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, false, NULL FROM lineitem WHERE l_suppkey % 4 = 3""",
)
def fastint_grade(spark, d):
    """Integers in four dresses, each read back to its canonical form."""
    n = F.col("l_partkey") % 50
    dress = F.expr("case l_suppkey % 4 when 0 then concat(' $', cast(l_partkey % 50 as string), '$ ') when 1 then concat('+00', cast(l_partkey % 50 as string)) when 2 then concat('\\\\text{ ', cast(l_partkey % 50 as string), ' }') else 'x+1' end")
    rows = table(spark, d, "lineitem").select(*_KEYS.split(", "), n.cast("string").alias("gold"), dress.alias("raw"))
    return rows.select(*_KEYS.split(", "), grading.fastint(F.col("gold"), F.col("raw")).alias("correct"), T.as_int(F.col("raw")).alias("pred"))


@query(
    "token_pos",
    _X + r""", a AS (SELECT *, replace(regexp_extract_all(text, '-?\d[\d,]*')[-1], ',', '') AS ans FROM x),
b AS (SELECT *, CASE WHEN length(ans) > 0 AND strpos(reverse(text), reverse(ans)) > 0 THEN length(text) - length(ans) - strpos(reverse(text), reverse(ans)) + 1 END AS start FROM a)
SELECT """ + _KEYS + """, start::BIGINT AS start, CASE WHEN start IS NULL THEN -1 ELSE round_even(start / length(text)::DOUBLE * l_quantity, 0) END::BIGINT AS pos FROM b""",
)
def token_pos(spark, d):
    rows = completions(spark, d).withColumn("start", T.find_last(F.col("text"), T.extract(F.col("text"), "last_int")))
    return rows.select(*_KEYS.split(", "), F.col("start").cast("bigint").alias("start"), T.answer_token_pos(F.col("text"), F.col("start"), F.col("l_quantity")).alias("pos"))


@query("repetition_ratio", "SELECT doc_id, CASE WHEN length(text) < 80 OR text IS NULL THEN 0.0 ELSE round(1 - len(list_distinct(b)) / len(b), 8) END AS ratio FROM (SELECT doc_id, text, list_transform(range(0, greatest(length(text) - 40, 0), 40), lambda i: substring(text, i + 1, 40)) AS b FROM documents)")
def repetition_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.repetition_ratio(F.col("text")), 8).alias("ratio"))


@query("clip_tail", "SELECT doc_id, right(text, 4096) AS tail FROM documents")
def clip_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tail(F.col("text")).alias("tail"))


@query("normalize_question", r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS question FROM documents")
def normalize_question(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_question(F.col("text")).alias("question"))


@query("seed_pack_unpack", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (((((3::BIGINT << 6) | l_linenumber) << 6 | (l_suppkey % 64)) << 10 | (l_partkey % 1024)) << 20) | (l_orderkey % 1048576) AS seed, l_orderkey % 1048576 AS sample_idx, l_partkey % 1024 AS problem_idx FROM lineitem")
def seed_pack_unpack(spark, d):
    c = F.col
    packed = ids.seed(epoch=F.lit(3), model_idx=c("l_linenumber"), dataset_idx=c("l_suppkey") % 64, problem_idx=c("l_partkey") % 1024, sample_idx=c("l_orderkey") % (1 << 20))
    rows = table(spark, d, "lineitem").select(*_KEYS.split(", "), packed.alias("seed"))
    return rows.select(*_KEYS.split(", "), "seed", ids.unpack(c("seed"))["sample_idx"].alias("sample_idx"), ids.unpack(c("seed"))["problem_idx"].alias("problem_idx"))


@query("sample_uid", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, substr(sha256(concat_ws(chr(31), 'e1', l_linestatus, 'd' || (l_suppkey % 3), 'plain', 'abc', l_suppkey, l_orderkey)), 1, 16) AS uid FROM lineitem")
def sample_uid(spark, d):
    uid = ids.sample_uid(F.lit("e1"), F.col("l_linestatus"), F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string")), F.lit("plain"), F.lit("abc"), F.col("l_suppkey"), F.col("l_orderkey"))
    return table(spark, d, "lineitem").select(*_KEYS.split(", "), uid.alias("uid"))


# Planning and integrity over a plan that the nations and suppliers stand for.
_PLAN = """WITH a AS (SELECT 'e1' AS exp_id, 'm' || n_nationkey AS model_key, 'd' || (n_nationkey % 3) AS dataset_key, CASE WHEN n_nationkey % 2 = 0 THEN 'plain' ELSE 'chat' END AS variant, 'abc' AS sampling_id, (4 + n_nationkey % 3) * 4 AS n_total, 4 AS chunk_size FROM nation),
q AS (SELECT 'd' || (s_suppkey % 3) AS dataset_key, floor(s_suppkey / 3)::BIGINT AS problem_idx FROM supplier),
w AS (SELECT dataset_key, problem_idx % 4 AS pshard, list_sort(list(problem_idx)) AS problem_idxs FROM q GROUP BY ALL),
u AS (SELECT a.*, w.pshard, w.problem_idxs, c AS chunk_idx, c * chunk_size AS sample_lo, (c + 1) * chunk_size AS sample_hi,
        substr(sha256(concat_ws(chr(31), exp_id, model_key, a.dataset_key, variant, sampling_id, pshard, c * chunk_size, (c + 1) * chunk_size)), 1, 12) AS unit_id
      FROM a JOIN w USING (dataset_key), LATERAL (SELECT unnest(range(n_total // chunk_size)) AS c)),
mk AS (SELECT unit_id, exp_id, model_key, dataset_key, variant, sampling_id, 'gen/' || unit_id AS chunk_path, CASE WHEN model_key = 'm7' AND chunk_idx = 0 THEN '1.1|cu' ELSE '1.0|cu' END AS engine_fingerprint FROM u WHERE substr(unit_id, 1, 1) <> 'a'
       UNION ALL SELECT 'feedfacefeed', 'e1', 'm0', 'd0', 'plain', 'abc', 'gen/feedfacefeed', '1.0|cu'),
gr AS (SELECT 'cfg' || x AS gradecfg, chunk_path FROM mk, (SELECT unnest([1, 2]) AS x) WHERE substr(unit_id, 2, 1) <> CASE WHEN x = 1 THEN 'b' ELSE 'c' END)
"""


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = table(spark, sf_dir, "nation").selectExpr("'e1' AS exp_id", "concat('m', cast(n_nationkey as string)) AS model_key", "concat('d', cast(n_nationkey % 3 as string)) AS dataset_key", "if(n_nationkey % 2 = 0, 'plain', 'chat') AS variant", "'abc' AS sampling_id", "(4 + n_nationkey % 3) * 4 AS n_total", "4 AS chunk_size")
    problems = table(spark, sf_dir, "supplier").selectExpr("concat('d', cast(s_suppkey % 3 as string)) AS dataset_key", "cast(floor(s_suppkey / 3) as bigint) AS problem_idx")
    return planning.build_plan(arms, problems, 4).withColumn("chunk_path", F.concat(F.lit("gen/"), "unit_id"))


def markers(units: DataFrame) -> DataFrame:
    cols = ["unit_id", "exp_id", "model_key", "dataset_key", "variant", "sampling_id", "chunk_path"]
    engine = F.when((F.col("model_key") == "m7") & (F.col("chunk_idx") == 0), "1.1|cu").otherwise("1.0|cu")
    rows = units.where("substring(unit_id, 1, 1) <> 'a'").select(*cols, engine.alias("engine_fingerprint"))
    stray = units.sparkSession.createDataFrame([("feedfacefeed", "e1", "m0", "d0", "plain", "abc", "gen/feedfacefeed", "1.0|cu")], rows.schema)
    return rows.unionByName(stray)


def graded(marks: DataFrame) -> DataFrame:
    rows = marks.select("unit_id", "chunk_path", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))
    return rows.where("substring(unit_id, 2, 1) <> if(x = 1, 'b', 'c')").select(F.concat(F.lit("cfg"), F.col("x").cast("string")).alias("gradecfg"), "chunk_path")


@query("plan_units", _PLAN + "SELECT unit_id, model_key, dataset_key, variant, pshard, chunk_idx, sample_lo, sample_hi, len(problem_idxs) AS n_problems, array_to_string(problem_idxs, ',') AS problems FROM u")
def plan_units(spark, d):
    return plan(spark, d).select("unit_id", "model_key", "dataset_key", "variant", "pshard", "chunk_idx", "sample_lo", "sample_hi", F.size("problem_idxs").alias("n_problems"), F.array_join("problem_idxs", ",").alias("problems"))


@query("remaining_units", _PLAN + "SELECT unit_id, pshard FROM u WHERE unit_id NOT IN (SELECT unit_id FROM mk)")
def remaining_units(spark, d):
    p = plan(spark, d)
    return planning.remaining(p, markers(p)).select("unit_id", "pshard")


@query("done_units", _PLAN + "SELECT unit_id FROM u WHERE unit_id IN (SELECT unit_id FROM mk)")
def done_units(spark, d):
    p = plan(spark, d)
    return planning.done(p, markers(p)).select("unit_id")


@query("orphans", _PLAN + "SELECT unit_id FROM mk WHERE unit_id NOT IN (SELECT unit_id FROM u)")
def orphans(spark, d):
    p = plan(spark, d)
    return planning.orphans(p, markers(p)).select("unit_id")


@query("coverage", _PLAN + "SELECT gradecfg, count(*) AS n_covered, (SELECT count(*) FROM mk WHERE unit_id IN (SELECT unit_id FROM u)) AS n_done FROM gr WHERE chunk_path IN (SELECT 'gen/' || unit_id FROM u) GROUP BY gradecfg")
def coverage(spark, d):
    p = plan(spark, d)
    m = markers(p)
    return verify.coverage(p, m, graded(m))


_CHECK = "SELECT '{0}' AS check, '{1}' AS severity, {2} AS arm, {3} AS detail FROM {4}"
_ARM = "concat_ws('/', model_key, dataset_key, variant, sampling_id)"


@query(
    "integrity_report",
    _PLAN
    + " UNION ALL ".join(
        (
            _CHECK.format("incomplete", "error", _ARM, "unit_id", "u WHERE unit_id NOT IN (SELECT unit_id FROM mk)"),
            _CHECK.format("orphan_marker", "error", "''", "unit_id", "mk WHERE unit_id NOT IN (SELECT unit_id FROM u)"),
            _CHECK.format("uncovered", "warning", _ARM, "'gen/' || unit_id", "u WHERE unit_id IN (SELECT unit_id FROM mk) AND 'gen/' || unit_id NOT IN (SELECT chunk_path FROM gr WHERE gradecfg = 'cfg1')"),
            _CHECK.format("engine_mix", "error", _ARM, "count(DISTINCT split_part(engine_fingerprint, '|', 1))::VARCHAR", "mk GROUP BY model_key, dataset_key, variant, sampling_id HAVING count(DISTINCT split_part(engine_fingerprint, '|', 1)) > 1"),
        )
    ),
)
def integrity_report(spark, d):
    p = plan(spark, d)
    m = markers(p)
    g = graded(m).where("gradecfg = 'cfg1'")
    return verify.report([verify.incomplete(p, m), verify.orphan_markers(p, m), verify.uncovered(p, m, g, require=False), verify.mixed_engines(m)])


_SAMPLES = """WITH s AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'base' ELSE 'rl' END AS model_key, 'd' || (l_suppkey % 3) AS dataset_key, 'plain' AS variant, 'abc' AS sampling_id, floor(l_suppkey / 3)::BIGINT AS problem_idx,
  (l_orderkey * 8 + l_linenumber)::BIGINT AS seed, substr(sha256(concat_ws(chr(31), l_orderkey, l_linenumber, l_suppkey)), 1, 16) AS sample_uid,
  CASE WHEN l_suppkey % 50 = 7 AND l_linenumber = 1 THEN 'drift' ELSE 'uid' END || l_suppkey AS problem_uid FROM lineitem)
"""


def seeded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    uid = ids.digest(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), n=16)
    return rows.selectExpr("*", "if(l_linestatus = 'F', 'base', 'rl') AS model_key", "concat('d', cast(l_suppkey % 3 as string)) AS dataset_key", "'plain' AS variant", "'abc' AS sampling_id", "cast(floor(l_suppkey / 3) as bigint) AS problem_idx", "cast(l_orderkey * 8 + l_linenumber as bigint) AS seed", "concat(if(l_suppkey % 50 = 7 and l_linenumber = 1, 'drift', 'uid'), cast(l_suppkey as string)) AS problem_uid").withColumn("sample_uid", uid)


@query("dup_seeds", _SAMPLES + f"SELECT 'duplicate_seed' AS check, 'error' AS severity, {_ARM} AS arm, count(*)::VARCHAR AS detail FROM (SELECT model_key, dataset_key, variant, sampling_id, seed FROM s GROUP BY ALL HAVING count(*) > 1) GROUP BY model_key, dataset_key, variant, sampling_id")
def dup_seeds(spark, d):
    return verify.duplicate_seeds(seeded_samples(spark, d))


@query("dup_uids", _SAMPLES + "SELECT 'duplicate_uid' AS check, 'error' AS severity, '' AS arm, sample_uid AS detail FROM s GROUP BY sample_uid HAVING count(*) > 1")
def dup_uids(spark, d):
    return verify.duplicate_uids(seeded_samples(spark, d))


@query("uid_drift", _SAMPLES + "SELECT 'manifest_drift' AS check, 'error' AS severity, dataset_key AS arm, problem_idx::VARCHAR AS detail FROM s GROUP BY dataset_key, problem_idx HAVING count(DISTINCT problem_uid) > 1")
def uid_drift(spark, d):
    return verify.drifted_problems(seeded_samples(spark, d))


@query("ragged_arms", _SAMPLES + f"SELECT 'ragged' AS check, 'error' AS severity, {_ARM} AS arm, min(m) || '..' || max(m) AS detail FROM (SELECT model_key, dataset_key, variant, sampling_id, problem_idx, count(*) AS m FROM s GROUP BY ALL) GROUP BY model_key, dataset_key, variant, sampling_id HAVING min(m) < max(m)")
def ragged_arms(spark, d):
    return verify.ragged(seeded_samples(spark, d))


@query("nullgold_join", "WITH q AS (SELECT DISTINCT 'd' || (s_suppkey % 3) AS dataset_key, floor(s_suppkey / 3)::BIGINT AS problem_idx, s_nationkey::VARCHAR AS answer FROM supplier) SELECT dataset_key, problem_idx, coalesce(lead(answer) OVER w, first_value(answer) OVER (PARTITION BY dataset_key ORDER BY problem_idx)) AS null_answer FROM q WINDOW w AS (PARTITION BY dataset_key ORDER BY problem_idx)")
def nullgold_join(spark, d):
    q = table(spark, d, "supplier").selectExpr("concat('d', cast(s_suppkey % 3 as string)) AS dataset_key", "cast(floor(s_suppkey / 3) as bigint) AS problem_idx", "cast(s_nationkey as string) AS answer")
    return grading.permuted_golds(q)


@query(
    "grade_wide",
    _X + f""", q AS (SELECT s_suppkey, s_nationkey::VARCHAR AS gold, lead(s_nationkey::VARCHAR) OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS nx, first_value(s_nationkey::VARCHAR) OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS fx FROM supplier),
e AS (SELECT x.*, gold, coalesce(nx, fx) AS nullg, replace(regexp_extract_all(text, '-?\\d[\\d,]*')[-1], ',', '') AS li, nullif(trim({_BOXES}[-1]), '') AS bl FROM x JOIN q ON s_suppkey = l_suppkey)
SELECT {_KEYS}, gold, li AS last_int, bl AS boxed_last, coalesce(TRY_CAST(li AS BIGINT) = gold::BIGINT, false) AS correct_li, coalesce(TRY_CAST(bl AS BIGINT) = gold::BIGINT, false) AS correct_bl,
       coalesce(TRY_CAST(li AS BIGINT) = nullg::BIGINT, false) AS null_li, len(list_distinct(regexp_extract_all(text, '-?\\d+'))) AS n_distinct_ints FROM e""",
)
def grade_wide(spark, d):
    q = table(spark, d, "supplier").selectExpr("concat('d', cast(s_suppkey % 3 as string)) AS dataset_key", "s_suppkey AS problem_idx", "cast(s_nationkey as string) AS answer")
    rows = completions(spark, d).withColumn("dataset_key", F.expr("concat('d', cast(l_suppkey % 3 as string))")).withColumn("problem_idx", F.col("l_suppkey")).withColumn("n_completion_tokens", F.col("l_quantity"))
    out = grading.grade(rows, q, grading.permuted_golds(q))
    return out.select(*_KEYS.split(", "), "gold", F.col("extracted__last_int").alias("last_int"), F.col("extracted__boxed_last").alias("boxed_last"), F.col("correct__fastint__last_int").alias("correct_li"), F.col("correct__fastint__boxed_last").alias("correct_bl"), F.col("nullgold__fastint__last_int").alias("null_li"), "n_distinct_ints")


@query("streaming_event_windows", "SELECT time_bucket(INTERVAL 1 day, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def streaming_event_windows(spark, d):
    """Drain the events as a stream with a watermark; complete mode hands every window to a Parquet sink. Each run has its own folder."""
    schema = table(spark, d, "events").schema
    where = f"{tree.shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    sink = lambda batch, _: batch.write.mode("overwrite").parquet(f"{where}/out")
    q = incremental.windowed_events(stream).writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
