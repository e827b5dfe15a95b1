"""Quality by positive-unlabelled learning.

The classifier never sees a negative.  It minimises the non-negative unbiased
PU risk (logistic loss) from trusted positives and unlabelled web text:

    R = pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

with an estimated class prior pi; where the second term falls below zero its
gradient is reversed, so the model can't drive it down by memorising positives.
A document is described by the shape of its whole text: frequencies of pairs of
character classes, and how much its words, word triples and lines repeat.

The prior is estimated from trusted positives and unlabelled texts alone
(:func:`estimate_prior`): a first model, fitted to one half of each, orders the
other halves; the share of unlabelled texts above a threshold over the share of
positives above it is least where no negative is left, and is the prior there.
The model is fitted on the driver to bounded samples (``POSITIVES``,
``UNLABELLED``) and has one weight per feature; scoring is one map-only scan.

Edge cases: a null text counts as empty; empty texts are scored like any other.
Labels that repeat a doc_id count once (positive if any says so); null labels
are left out.  Without any positive or any text to train on, every score is 0.5.
Each input row gives one row; other columns are
not read.
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

POSITIVES, UNLABELLED = 6000, 12000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7

#: Character classes: other, lower, upper, digit, blank, line end, '.', ',', '!', '?', '|', marks, quotes and brackets, non-ASCII.
CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!", b"?", b"|", b"#$%&*+=<>@^_~\\/", b"'\"()[]{}-:;`"), 1):
    CLASS[list(_chars)] = _i
CLASS[0x80:] = 13
CLASSES = 14
SHAPE = 10
FEATURES = CLASSES * CLASSES + SHAPE


def _repeats(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: how many items, how many distinct ones, and the largest count of one."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[at], np.diff(np.append(at, len(r))))
    return np.bincount(row, minlength=n), np.bincount(r[at], minlength=n), top


def _features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    out = np.zeros((n, FEATURES), np.float32)
    size = np.diff(offs)
    c = CLASS[data]
    if len(data) > 1:
        row = np.repeat(np.arange(n), size)
        same = row[1:] == row[:-1]
        pair = (row[:-1] * (CLASSES * CLASSES) + c[:-1] * CLASSES + c[1:])[same]
        out[:, : CLASSES * CLASSES] = np.sqrt(np.bincount(pair, minlength=n * CLASSES * CLASSES).reshape(n, -1) / np.maximum(size - 1, 1)[:, None])
    s, e, own = K.word_spans(data, offs, K.NOT_SPACE)
    h = K.span_hash(data, s, e)
    words, distinct, top = _repeats(own, h, n)
    triples = np.flatnonzero(own[2:] == own[:-2]) if len(own) > 2 else np.zeros(0, np.int64)
    t_all, t_distinct, t_top = _repeats(own[triples], K.gram_hash(h, 3)[triples], n)
    twice = np.bincount(own[1:][(own[1:] == own[:-1]) & (h[1:] == h[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    line = np.ones(256, bool)
    line[[10, 13]] = False
    ls, le, lown = K.word_spans(data, offs, line)
    lines, l_distinct, _ = _repeats(lown, K.span_hash(data, ls, le), n)
    some = np.maximum(words, 1)
    shape = (np.log1p(size), np.log1p(words), np.bincount(own, weights=e - s, minlength=n) / some, 1 - distinct / some, top / some, 1 - t_distinct / np.maximum(t_all, 1), t_top / np.maximum(t_all, 1), twice / some, 1 - l_distinct / np.maximum(lines, 1), lines / some)
    out[:, CLASSES * CLASSES :] = np.stack(shape, 1)
    return out


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in K.slices(b.column("text")):
            f = _features(data, offs)
            yield pa.RecordBatch.from_arrays([b.column("y").slice(lo, hi - lo), K.lists(f.ravel(), np.full(hi - lo, FEATURES), pa.float32())], ["y", "f"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, f: np.ndarray) -> np.ndarray:
        return L.sigmoid(np.clip((f - self.mean) / self.scale, -8, 8) @ self.weights + self.bias)


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, rounds: int = 600, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Minimise the non-negative PU risk of a linear model with Adam."""
    mean, scale = unl.mean(0), unl.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float64) for x in (pos, unl))
    x = np.zeros(p.shape[1] + 1)
    x[-1] = np.log(prior / (1 - prior))
    adam = L.Adam(len(x), rate)
    for _ in range(rounds):
        gp, gu = L.sigmoid(p @ x[:-1] + x[-1]), L.sigmoid(u @ x[:-1] + x[-1])
        # l(g) = -log s(g), l(-g) = -log s(-g): their slopes in g are s - 1 and s.
        rest = np.logaddexp(0, u @ x[:-1] + x[-1]).mean() - prior * np.logaddexp(0, p @ x[:-1] + x[-1]).mean()
        dp, du = prior * gp / len(p), gu / len(u)
        if rest >= 0:
            dp, du = prior * (gp - 1) / len(p) - dp, du
        else:
            dp, du = dp, -du
        adam.step(x, np.append(p.T @ dp + u.T @ du + decay * x[:-1], dp.sum() + du.sum()))
    return Model(mean, scale, x[:-1], float(x[-1]))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, sure: float = 0.1) -> float:
    """The share of positives among the unlabelled texts, at the threshold of the least upper confidence bound."""
    model = fit(pos[::2], unl[::2], 0.5)
    p, u = np.sort(model.score(pos[1::2])), np.sort(model.score(unl[1::2]))
    at = np.unique(p)
    above = lambda x: 1 - np.searchsorted(x, at, side="left") / len(x)
    slack = lambda x: np.sqrt(np.log(4 / sure) / (2 * len(x)))
    bound = np.where(above(p) > 2 * slack(p), (above(u) + slack(u)) / np.maximum(above(p) - slack(p), 1e-9), np.inf)
    best = int(np.argmin(bound))
    return float(np.clip(above(u)[best] / above(p)[best], 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit to trusted positives and unlabelled texts outside the held-out fold; labels of the other kind are not used."""
    known = labels.where("quality = 1").where(~L.held_out("doc_id", FOLDS, HELD_OUT))
    trusted = L.first_ids(known, positives).withColumn("y", F.lit(1))
    web = L.first_ids(docs.where(~L.held_out("doc_id", FOLDS, HELD_OUT)), unlabelled).withColumn("y", F.lit(0))
    got = L.with_texts(docs, trusted.unionByName(web)).select("y", "text").mapInArrow(_sample, "y int, f array<float>").toArrow().combine_chunks()
    y = got.column("y").to_numpy()
    f = got.column("f").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((*f.T[:2], *f.T[-SHAPE:]))  # whatever order the rows came in
    y, f = y[order], f[order]
    pos, unl = f[y == 1], f[y == 0]
    if len(pos) < 2 or len(unl) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    mixed = np.random.default_rng(len(y))
    pos, unl = pos[mixed.permutation(len(pos))], unl[mixed.permutation(len(unl))]
    return fit(pos, unl, estimate_prior(pos, unl))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in K.slices(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(shared.value.score(_features(data, offs)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
