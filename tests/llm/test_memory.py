"""What the stages of the pipeline leave in the Python workers' memory."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from korral.llm import _kernel as K
from korral.llm import ngram_join as N
from korral.llm.mixing import mix


def held() -> int:
    """MB of this process without mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) // 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads Linux's memory maps")
def test_workers_keep_no_texts(spark):
    """A worker that has dealt out 20 MB of texts waits for its next task with little more than its modules."""
    words = F.expr("transform(sequence(1, 400), i -> substring(md5(concat(id, ' ', i)), 1, 7))")
    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    none = spark.sparkContext.broadcast(np.zeros(4096, np.uint8))
    before = {r.pid for r in probe(spark).collect()}
    for _ in range(3):
        N.incidence(docs, N.SHINGLE, N.BLOCKS, none, N.PERCENT).count()
    after = probe(spark).collect()
    assert before & {r.pid for r in after} and max(r.mb for r in after) < 90


def probe(spark):
    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([held()])], ["pid", "mb"])

    return spark.range(0, 16, 1, 16).mapInArrow(look, "pid long, mb long")


def test_batches_of_a_cut_are_bounded_in_bytes(spark):
    """Texts of 40 MB reach the worker a few MB at a time, and the session's own setting stands afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)

    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("text "), 2000).alias("text"))
    seen = K.cut(docs.mapInArrow(look, "n long, size long")).collect()
    assert sum(r.n for r in seen) == 4000 and max(r["size"] for r in seen) < 1 << 23
    assert spark.conf.get(name) == was
    with pytest.raises(Exception, match="no such"):
        K.cut(spark.range(1).select(F.raise_error(F.lit("no such"))))
    assert spark.conf.get(name) == was


def test_a_mix_starts_no_workers(spark, monkeypatch):
    """The plan isn't handed to Spark as a list, which has workers of its own copy it; sources of any type mix."""

    def listed(*_, **__):
        raise AssertionError("a list was parallelised")

    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("source"), F.lit("a b c").alias("text"))
    monkeypatch.setattr(SparkContext, "parallelize", listed)
    for source in (F.col("source"), F.concat(F.lit("s"), F.col("source").cast("string"))):
        rows = mix(docs.withColumn("source", source)).collect()
        assert len(rows) == 20 and sum(r.taken for r in rows if r.members == [None]) > 0 and all(r.source_size == (21 if r.doc_id % 3 < 2 else 18) for r in rows)
