"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
its words and word fronts; a document's is their noisy-or, 1 - prod(1 - p), so
one offending sentence is enough and a clean one changes nothing.  The weights
are trained from document labels alone, through the noisy-or; the sentences
that carry a document's score are then known.

The model is fitted on the driver to a bounded sample of labelled rows
(``POSITIVES`` and ``NEGATIVES``, reweighted to the labels' own proportion) and
has at most ``FEATURES`` weights.  Features are ranked on the executors, and
only the occurrences of those that get a weight reach the driver; scoring is one map-only scan of whole texts.

Edge cases: a null or wordless text has no sentence and score 0.  Labels that
repeat a doc_id count once (toxic if any says so); null labels are left out.
Texts over ``learning.TRAIN_BYTES`` bytes are scored but not trained on.  Without
texts with labels of both kinds every text with words scores 1 if there are toxic
labels, else 0.  Each input row gives one row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korral.llm import _kernel as K
from korral.llm import learning as L

POSITIVES, NEGATIVES, FEATURES = 1500, 3000, 6000
#: Least chi-square of a feature with the label.
RANK = 25
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Word fronts, in bytes, that are features beside the word itself.
FRONTS = (5, 6, 7, 8)
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    keys: np.ndarray  # sorted 64-bit features
    weights: np.ndarray
    bias: float
    bits: np.ndarray  # bitmap of the keys: most words are no feature


def _features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row and first and last byte of each sentence, sentence of each word, the words' features)."""
    s, e, row = K.word_spans(data, offs, K.ALNUM)
    stops = np.cumsum(ENDS[data])[s] if len(s) else s
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (stops[1:] != stops[:-1])
    sentence = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(s)) - 1 if len(at) else at
    h, fronts = K.value_hash(K.BYTE_VALUE[K.LOWER][data], s, e, FRONTS)
    return row[at], np.stack((s[at], e[last]), 1) if len(at) else np.zeros((0, 2), np.int64), sentence, h, fronts


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lengths of the sentences in features, features) of each training document."""
    for b in batches:
        for lo, hi, data, offs in K.slices(b.column("text"), 1 << 19):
            row, _, sentence, h, fronts = _features(data, offs)
            every = np.stack([h, *fronts], 1)
            own = np.repeat(sentence, every.shape[1])[every.ravel() != 0]
            flat = every.ravel()[every.ravel() != 0]
            sizes = np.bincount(own, minlength=len(row))
            per_doc = np.bincount(row, minlength=hi - lo)
            features = np.bincount(row[own], minlength=hi - lo) if len(own) else np.zeros(hi - lo, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("y").slice(lo, hi - lo), K.lists(sizes.astype(np.int32), per_doc, pa.int32()), K.lists(flat.view(np.int64), features, pa.int64())], ["y", "sizes", "features"])


def _ranked(sample: DataFrame, features: int) -> np.ndarray:
    """The features that :func:`fit` gives a weight, ranked on the executors: at most ``features`` values reach the driver."""
    n, positive = sample.agg(F.count("*"), F.sum("y")).first()
    each = sample.select("y", F.explode(F.array_distinct("features")).alias("key")).groupBy("key").agg(F.sum("y").alias("pos"), F.count("*").alias("df")).where("df >= 3")
    share = positive / n
    off = F.col("pos") - F.col("df") * F.lit(share)
    rank = off * off / (F.col("df") * F.lit(share * (1 - share))) * (F.lit(float(n)) / F.greatest(F.lit(n) - F.col("df"), F.lit(1)))
    # A rank on the bound is let through: fit decides on it. Ties go to the smaller unsigned key, as there.
    best = each.withColumn("rank", rank).where(F.col("rank") > RANK * (1 - 1e-9)).orderBy(F.desc("rank"), F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).limit(features)
    return np.sort(np.array([r.key for r in best.select("key").collect()], np.int64))


def _only(sample: DataFrame, keys: np.ndarray) -> DataFrame:
    """The sample with all its sentences, but of the features only ``keys``."""
    shared = sample.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, flat = b.column("sizes"), b.column("features")
            per_doc, size = np.diff(sizes.offsets.to_numpy()), sizes.flatten().to_numpy()
            f, count = flat.flatten().to_numpy(), np.diff(flat.offsets.to_numpy())
            ok = np.isin(f, shared.value)
            size = np.bincount(np.repeat(np.arange(len(size)), size)[ok], minlength=len(size))
            count = np.bincount(np.repeat(np.arange(len(count)), count)[ok], minlength=len(count))
            yield pa.RecordBatch.from_arrays([b.column("y"), K.lists(size.astype(np.int32), per_doc, pa.int32()), K.lists(f[ok], count, pa.int64())], ["y", "sizes", "features"])

    return K.map_arrow(sample, run, sample.schema)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, features: int = FEATURES) -> Model:
    """Fit the sentence model to document labels outside the held-out fold."""
    known = labels.where("toxic is not null").where(~L.held_out("doc_id", FOLDS, HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    total = {int(r.y): r["count"] for r in known.groupBy("y").count().collect()}
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -60.0 if not total.get(1) else 60.0, np.zeros(4096, np.uint8))
    if not total.get(0) or not total.get(1):
        return none
    ids = L.first_ids(known.where("y = 1"), positives).withColumn("y", F.lit(1)).unionByName(L.first_ids(known.where("y = 0"), negatives).withColumn("y", F.lit(0)))
    sample = K.cut(K.map_arrow(L.with_texts(docs, ids).select("y", "text"), _sample, "y int, sizes array<int>, features array<bigint>"))
    kinds = sample.agg(F.min("y"), F.max("y")).first()
    if kinds[0] == kinds[1]:  # no row, or of one kind only
        return none
    got = _only(sample, _ranked(sample, features)).toArrow().combine_chunks()
    y = got.column("y").to_numpy().astype(bool)
    return fit(y, got.column("sizes").combine_chunks(), got.column("features").combine_chunks(), total, features)


def fit(y: np.ndarray, sizes: pa.ListArray, flat: pa.ListArray, total: dict[int, int], features: int) -> Model:
    """The weights that minimise the log loss of the noisy-or over the sample."""
    count = np.diff(sizes.offsets.to_numpy())
    doc_of = np.repeat(np.arange(len(y)), count)
    sentence = np.repeat(np.arange(len(doc_of), dtype=np.int32), sizes.flatten().to_numpy())
    keys, f = np.unique(flat.flatten().to_numpy().view(np.uint64), return_inverse=True)
    f = f.astype(np.int32)
    # Features are ranked by the chi-square of being in a document of either kind.
    pair = f.astype(np.int64)
    pair *= len(y)
    pair += doc_of[sentence]
    pair.sort()
    pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))]
    pos = np.bincount(pair // len(y), weights=y[pair % len(y)], minlength=len(keys))
    df = np.bincount(pair // len(y), minlength=len(keys))
    share, n = y.mean(), len(y)
    rank = (pos - df * share) ** 2 / (df * share * (1 - share)) * (n / np.maximum(n - df, 1))
    rank[df < 3] = 0
    best = np.sort(np.argsort(-rank, kind="stable")[: min(features, int((rank > RANK).sum()))])
    keys, number = keys[best], np.full(len(keys), -1)
    number[best] = np.arange(len(best))
    f = number[f]
    sentence, f = sentence[f >= 0], f[f >= 0]
    # Each label kind weighs as in the labels, not as in the sample.
    kinds = np.array([total[0] / max(1, (~y).sum()), total[1] / max(1, y.sum())])
    weight = kinds[y.astype(int)]
    weight /= weight.sum()
    x = np.zeros(len(best) + 1)
    x[-1] = -np.log(np.maximum(count, 1).mean()) - 3
    adam = L.Adam(len(x), 0.1)
    for _ in range(400):
        z = x[-1] + np.bincount(sentence, weights=x[:-1][f], minlength=len(doc_of))
        a = np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=len(y))
        d = np.where(y, -1 / np.maximum(np.expm1(np.minimum(a, 50)), 1e-6), 1.0) * weight
        g = d[doc_of] * L.sigmoid(z)
        adam.step(x, np.append(np.bincount(f, weights=g[sentence], minlength=len(best)) + 2e-5 * x[:-1], g.sum()))
    bits = np.zeros(1 << 19, np.uint8)
    slot = keys & np.uint64((1 << 22) - 1)
    np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8)))
    return Model(keys, x[:-1].copy(), float(x[-1]), bits)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, uid, score, n_sentences, and the offending sentences: score, start and end (code points of the text), text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo, hi, data, offs in K.slices(b.column("text")):
                row, span, sentence, h, fronts = _features(data, offs)
                z = np.full(len(row), m.bias)
                for x in (h, *fronts):
                    at = np.flatnonzero(K.in_bitmap(m.bits, x)) if len(m.keys) else np.zeros(0, np.int64)
                    i = np.minimum(np.searchsorted(m.keys, x[at]), max(len(m.keys) - 1, 0))
                    at, i = at[m.keys[i] == x[at]], i[m.keys[i] == x[at]]
                    z += np.bincount(sentence[at], weights=m.weights[i], minlength=len(row))
                log_clean = np.bincount(row, weights=np.logaddexp(0, z), minlength=hi - lo)
                p = L.sigmoid(z)
                bad = np.flatnonzero(p >= threshold)
                texts = [bytes(data[a:e]).decode("utf-8", "replace") for a, e in span[bad]]
                per = np.bincount(row[bad], minlength=hi - lo)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if len(bad) else np.zeros(1, np.int64)
                place = points[span[bad]] - points[offs[row[bad]]][:, None] if len(bad) else np.zeros((0, 2), np.int64)
                found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(p[bad], pa.float64()), pa.array(place[:, 0], pa.int64()), pa.array(place[:, 1], pa.int64()), pa.array(texts, pa.string())], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("uid").slice(lo, hi - lo), pa.array(-np.expm1(-log_clean), pa.float64()), pa.array(np.bincount(row, minlength=hi - lo), pa.int64()), found], ["doc_id", "uid", "score", "n_sentences", "offending"])

    source = docs.select("doc_id", K.uid(docs).alias("uid"), F.col("text").cast("string").alias("text"))
    return K.map_arrow(source, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, uid bigint, score double, n_sentences bigint, offending array<struct<score:double,start:bigint,end:bigint,text:string>>")
