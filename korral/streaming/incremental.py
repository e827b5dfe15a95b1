"""Incremental processing with Structured Streaming.

New sample shards are graded once each: a file source with a checkpoint remembers
what was read, ``availableNow`` drains what is there, and every micro-batch writes
data first and its marker last, so a reader that trusts markers never sees half a
batch.  A batch that is replayed after a failure overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from korral.sources import tree


def sample_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New zstd-JSONL (or JSONL) shards under a root; a late duplicate of a sample is dropped within the batch by its uid."""
    return spark.readStream.schema(tree.SAMPLES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").option("maxFilesPerTrigger", per_trigger).json(root)


def process_new(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "sample_uid") -> StreamingQuery:
    """Drain a stream through ``process`` into out/batch=N, each certified by a marker."""

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{out}/batch={number:06d}"
        if tree.exists(spark, tree.marker_path(path)):
            return  # replayed after its marker was written
        done = process(batch.dropDuplicates([key]))
        seen = certified(spark, out)
        if seen is not None:  # a sample in an earlier batch wins
            done = done.join(seen.select(key), key, "left_anti")
        done.write.mode("overwrite").parquet(path)
        n = spark.read.parquet(path).count()
        tree.write_marker(spark, path, f"batch-{number}", {"n_rows": n})

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def certified(spark: SparkSession, out: str) -> DataFrame | None:
    """All rows of the certified batches, or None before the first."""
    if not tree.exists(spark, out):
        return None
    paths = [r.data_path for r in tree.read_markers(spark, out).select("data_path").toLocalIterator()]
    return spark.read.parquet(*paths) if paths else None


def running_counts(stream: DataFrame) -> DataFrame:
    """Hits and samples of each arm and problem as shards arrive (update mode)."""
    return stream.groupBy("model_key", "dataset_key", "problem_idx").agg(F.count_if("correct").alias("c"), F.count("*").alias("n"))


def windowed_events(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by type and tumbling window, with a watermark for late ones."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
