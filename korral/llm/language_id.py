"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language.  An unseen word
backs off to its character n-grams (with marks at both ends), the longest order
of which any is known, and adds the mean of their log frequencies.  Scores are
added over the whole text, and the language with the most is predicted.

Counts come from texts with a known language outside the held-out fold, at most
``PER_LANGUAGE`` rows of each language (a documented bound of the fit) and at
most ``LANGUAGES`` languages; the model keeps the ``WORDS`` most frequent words
and ``GRAMS`` most frequent n-grams of each order, so what is broadcast is
bounded.  Scoring is one map-only scan of whole texts.

Edge cases: ``und`` with score 0 if a text is null or has no letter, and if
nothing could be learned.  Ties go to the language first by code point.  A
training text of a null or held-out row is never read.  Each input row gives
one row; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korral.llm import _kernel as K
from korral.llm import learning as L

PER_LANGUAGE, LANGUAGES, WORDS, GRAMS = 1500, 200, 60_000, 30_000
ORDERS = (5, 4, 3, 2, 1)
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_U = np.uint64


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and what they are in lower case (where that is one code point)."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
    low = np.fromiter((ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)), np.uint32, 0x110000)
    return np.fromiter((c.isalpha() for c in chars), bool, 0x110000), low


def _points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points (0 for what is no letter), and the rows' offsets in them."""
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter, low = _letters()
    return np.where(is_letter[cp], low[cp], 0), lead[offs]


def _words(cp: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of every run of letters."""
    m = np.empty(256, bool)
    m[:] = True
    m[0] = False
    s, e, row = K.word_spans(np.minimum(cp, 1).astype(np.uint8), offs, m)
    h, _ = K.value_hash(K.mix(cp.astype(np.uint64)), s, e)
    return s, e, row, h


def _grams(cp: np.ndarray, s: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hash) of all k-grams of the words between an opening and a closing mark."""
    size = e - s + 2
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    word = np.repeat(np.arange(len(s)), size)
    last = np.repeat(size, size) - 1
    v = np.where(at == 0, 1, np.where(at == last, 2, cp[np.minimum(np.repeat(s, size) + np.maximum(at - 1, 0), len(cp) - 1)]))
    if k == 1:  # the marks alone say nothing
        keep = (at > 0) & (at < last)
        return word[keep], K.gram_hash(K.mix(v.astype(np.uint64)), 1)[keep]
    h = K.gram_hash(K.mix(v.astype(np.uint64)), k)
    keep = np.flatnonzero(word[: len(h)] == word[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    return word[keep], h[keep]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, order, key, n), added up over each slice; order 0 are words. N-grams count once per distinct word occurrence."""
    for b in batches:
        langs = np.array(b.column("lang").to_pylist(), object)
        names, number = np.unique(langs, return_inverse=True)
        for lo, hi, data, offs in K.slices(b.column("text")):
            cp, at = _points(data, offs)
            s, e, row, h = _words(cp, at)
            if not len(s):
                continue
            lang = number[lo:hi][row]
            for k in (0, *ORDERS):
                who, key = (lang, h) if k == 0 else (lambda w, g: (lang[w], g))(*_grams(cp, s, e, k))
                order = np.lexsort((key, who))
                who, key = who[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1])
                i = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(names[who[i]].tolist(), pa.string()), pa.array(np.full(len(i), k), pa.int32()), pa.array(key[i].view(np.int64)), pa.array(np.diff(np.append(i, len(key))), pa.int64())], ["lang", "ord", "key", "n"])


@dataclass
class Model:
    langs: list[str]
    #: By order (0: words): sorted keys and log frequencies by language.
    tables: dict[int, tuple[np.ndarray, np.ndarray]]

    def score(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed log scores by row and language, words by row)."""
        n, width = len(offs) - 1, len(self.langs)
        cp, at = _points(data, offs)
        s, e, row, h = _words(cp, at)
        out = np.zeros((n, width))

        def add(own: np.ndarray, values: np.ndarray) -> None:
            for j in range(width):
                out[:, j] += np.bincount(own, weights=values[:, j], minlength=n)

        known, i = self._find(0, h)
        add(row[known], self.tables[0][1][i])
        left = np.flatnonzero(~known)
        for k in ORDERS:
            if not len(left):
                break
            # Unseen words recur: each distinct one is looked up once.
            _, one, back = np.unique(h[left], return_index=True, return_inverse=True)
            word, g = _grams(cp, s[left[one]], e[left[one]], k)
            hit, i = self._find(k, g)
            word = word[hit]
            found = np.bincount(word, minlength=len(one))
            mean = np.stack([np.bincount(word, weights=self.tables[k][1][i, j], minlength=len(one)) for j in range(width)], 1) / np.maximum(found, 1)[:, None]
            ok = found[back] > 0
            add(row[left[ok]], mean[back[ok]])
            left = left[~ok]
        return out, np.bincount(row, minlength=n)

    def _find(self, k: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.tables[k][0]
        if not len(keys):
            return np.zeros(len(x), bool), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        hit = keys[i] == x
        return hit, i[hit]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Count words and n-grams by language outside the held-out fold."""
    spark = docs.sparkSession
    own = docs.where("lang is not null and doc_id is not null").where(~L.held_out("doc_id", FOLDS, HELD_OUT)).select("doc_id", F.col("lang").cast("string").alias("lang"))
    langs = [(r.lang, r["count"]) for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    langs.sort()
    if not langs:
        return Model([], {})
    # The hash threshold that leaves about per_language rows of each language.
    share = F.create_map(*(F.lit(x) for lang, n in langs for x in (lang, min(1.0, per_language / n))))
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / 1_000_003
    text = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null and doc_id is not null").where(~L.held_out("doc_id", FOLDS, HELD_OUT))
    some = text.where(u < F.try_element_at(share, F.col("lang"))).select("lang", "text")
    sums = K.cut(some.mapInArrow(_counts, "lang string, ord int, key bigint, n bigint").groupBy("ord", "key", "lang").agg(F.sum("n").alias("n")))
    tables = {}
    names = {lang: j for j, (lang, _) in enumerate(langs)}
    total = {(r.ord, r.lang): (r.n, r.kinds) for r in sums.groupBy("ord", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    for k in (0, *ORDERS):
        top = sums.where(F.col("ord") == k).groupBy("key").agg(F.sum("n").alias("all")).where("all >= 2").orderBy(F.desc("all"), "key").limit(words if k == 0 else grams).select("key")
        got = sums.where(F.col("ord") == k).join(F.broadcast(top), "key").select("key", "lang", "n").toArrow().combine_chunks()
        keys, i = np.unique(got.column("key").to_numpy().view(np.uint64), return_inverse=True)
        freq = np.zeros((len(keys), len(langs)))
        lang = np.array([names.get(x, -1) for x in got.column("lang").to_pylist()], int)
        freq[i[lang >= 0], lang[lang >= 0]] = got.column("n").to_numpy()[lang >= 0]
        size = np.array([total.get((k, x), (0, 0))[0] for x in names], float)
        # One floor for all languages, so that one with little text doesn't gain by what it hasn't seen.
        tables[k] = (keys, np.log(freq / np.maximum(size, 1) + 0.5 / max(size.max(initial=0), 1)))
    return Model([x for x, _ in langs], tables)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, lang_pred and score (the posterior of that language under equal priors)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for b in batches:
            for lo, hi, data, offs in K.slices(b.column("text")):
                if not m.langs:
                    best, p = np.zeros(hi - lo, int), np.zeros(hi - lo)
                else:
                    z, words = m.score(data, offs)
                    best = z.argmax(1)
                    p = 1 / np.exp(np.clip(z - z.max(1, keepdims=True), -700, 0)).sum(1)
                    best[words == 0], p[words == 0] = len(m.langs), 0.0
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(names[best].tolist(), pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
