"""What the trained operators share: folds, bounded training samples, an optimiser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def held_out(doc_id: str, parts: int, part: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


#: Texts of more bytes than this aren't trained on, so a sample is bounded in bytes, too.
TRAIN_BYTES = 200_000


def first_ids(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` ids that come first by hash: a bounded, reproducible sample (a top-n, no full sort).

    Only ids below a bound of the hash are made distinct, one that leaves about four times as many rows as wanted;
    where rows repeat so much that fewer ids are below it, the bound is raised.
    """
    some = ids.where("doc_id is not null").select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    total, share = some.count(), 1.0
    if total > 8 * n:
        share = 4 * n / total
        while share < 1 and some.where(F.col("h") < _below(share)).select("doc_id").distinct().limit(n).count() < n:
            share *= 8
    few = some.where(F.col("h") < _below(share)) if share < 1 else some
    return few.distinct().orderBy("h", "doc_id").limit(n).select("doc_id")


def _below(share: float) -> int:
    return int(-(1 << 63) + share * (1 << 64))


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, y, text) of a bounded sample of ids (so the broadcast is bounded, too): of an id's texts up to TRAIN_BYTES the least one."""
    text = F.col("text").cast("string")
    met = docs.select("doc_id", text.alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).join(F.broadcast(ids), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


class Adam:
    """Adam on one flat parameter vector."""

    def __init__(self, n: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
