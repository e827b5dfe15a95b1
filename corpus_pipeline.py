"""The corpus pipeline: five stages, each over all that the one before kept.

Between stages the documents are written as Parquet to the shared checkpoint
folder and read again, so a stage's lineage is one scan and a lost executor
costs no earlier stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from korral.llm import _kernel, stages

#: (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_copies),
    ("ngram_jaccard_join", stages.drop_near_copies),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("source_mixing", stages.mix_sources),
]

#: The toxicity stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage has written goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{_kernel.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{out}/{i}-{name}")
            docs = spark.read.parquet(f"{out}/{i}-{name}")
            if i:
                _remove(spark, f"{out}/{i - 1}-{STAGES[i - 1][0]}")
    return docs


def _remove(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
