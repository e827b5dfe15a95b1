"""Benchmark decontamination by winnowing.

Every text becomes words; of every ``window`` consecutive words the smallest
k-gram hash is kept, its fingerprint.  With ``k + w - 1 = window`` such a window is
exactly one winnowing window of ``w`` k-grams, so two texts that share a span of
``window`` words keep the same fingerprint for it: no shared span of that length
can be missed.  Documents and benchmark are joined on their fingerprints; every
hit is extended to the window around it and the words themselves are compared.
The hit words are the union of the windows that match.

Scale: one scan of the documents; what leaves it is a row per document and the
windows, with their words, whose fingerprint and hash of all words pass bitmaps
of the benchmark's (at most ``2 ** MAX_BITS`` bits, 16 MB each, whatever the
benchmark's size; full ones let more windows through and change no result).  The
join's side of the benchmark has one row per distinct window, so a passage in a
third of all documents is a skewed key with one row on the other side, which AQE
splits.  Items are looked up by distinct window of a document, as rows.

Edge cases: a null or wordless text has no words and is never contaminated; an
item with fewer than ``window`` words is one window of its own length; a
wordless item has no window.  Each input row gives one output row, also where a
doc_id repeats or is null; other columns of the inputs are not read.  Items that
repeat an item_id count once.  Empty tables give empty results (an empty
benchmark: no hits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korral.llm import _kernel as K

WINDOW, GRAM = 13, 5
MAX_BITS = 27
_HITS = "array<struct<start:int,size:int,fp:bigint,words:string>>"


def _windows(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, winnowed fingerprint, hash of the window) of every window inside one row."""
    n = len(words) - size + 1
    if n <= 0:
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), z, z
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    k = min(GRAM, size)
    grams = K.gram_hash(words, k)
    low, reach, need = grams, 1, size - k + 1
    while reach < need:  # sliding minimum by doubling
        step = min(reach, need - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return at, low[at] ^ np.uint64(size), K.gram_hash(words, size)[at]


def _words(data: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[str]:
    """The words of windows, A-Z in lower case, one space between them."""
    return [b" ".join(K.LOWER[data[s[j] : e[j]]].tobytes() for j in range(i, i + n)).decode("utf-8", "surrogateescape") for i, n in zip(at.tolist(), size.tolist(), strict=True)]


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offs in K.slices(b.column("text")):
            s, e, row = K.word_spans(data, offs, K.ALNUM)
            words = K.span_hash(data, s, e, K.LOWER)
            count = np.bincount(row, minlength=hi - lo)
            ids = b.column("item_id").slice(lo, hi - lo)
            for size in np.unique(np.minimum(count[count > 0], window)):
                if size == window:
                    at, fp, win = _windows(words, row, window)
                else:
                    at = np.searchsorted(row, np.flatnonzero(count == size))
                    grams = [_windows(words[a : a + size], np.zeros(size, int), int(size)) for a in at]
                    fp, win = np.concatenate([g[1] for g in grams]), np.concatenate([g[2] for g in grams])
                text = _words(data, s, e, at, np.full(len(at), size))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[at])), pa.array(np.full(len(at), size), pa.int32()), pa.array(fp.view(np.int64)), pa.array(win.view(np.int64)), pa.array(text, pa.string())], ["item_id", "size", "fp", "win", "words"])


def windows_of_items(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, size, fp, win, words) of the benchmark's windows."""
    kind = items.schema["item_id"].dataType.simpleString()
    return K.map_arrow(items.select("item_id", "text"), lambda it: _item_windows(it, window), f"item_id {kind}, size int, fp bigint, win bigint, words string").distinct()


def scan(docs: DataFrame, item_windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per document: doc_id, uid, n_words, and the windows that pass the benchmark's bitmaps."""
    spark = docs.sparkSession
    n, sizes = item_windows.agg(F.count("*"), F.collect_set("size")).first()
    fps, wins = (spark.sparkContext.broadcast(K.bitmap(item_windows, c, K.bitmap_bits(n, MAX_BITS))) for c in ("fp", "win"))
    sizes = sorted(int(x) for x in sizes)
    kind = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("fp", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in K.slices(b.column("text")):
                s, e, row = K.word_spans(data, offs, K.ALNUM)
                words = K.span_hash(data, s, e, K.LOWER)
                count = np.bincount(row, minlength=hi - lo)
                first = np.concatenate(([0], np.cumsum(count)))
                found = []
                for size in sizes:
                    at, fp, win = _windows(words, row, size)
                    ok = np.flatnonzero(K.in_bitmap(fps.value, fp))
                    ok = ok[K.in_bitmap(wins.value, win[ok])]
                    found.append((at[ok], np.full(len(ok), size, np.int32), fp[ok]))
                at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                size = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int32)
                fp = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.uint64)
                order = np.argsort(at, kind="stable")
                at, size, fp = at[order], size[order], fp[order]
                own = row[at]
                hits = pa.StructArray.from_arrays([pa.array((at - first[own]).astype(np.int32)), pa.array(size), pa.array(fp.view(np.int64)), pa.array(_words(data, s, e, at, size), pa.string())], fields=list(kind))
                per = np.bincount(own, minlength=hi - lo)
                offsets = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("uid").slice(lo, hi - lo), pa.array(count, pa.int64()), pa.ListArray.from_arrays(offsets, hits)], ["doc_id", "uid", "n_words", "hits"])

    source = docs.select("doc_id", K.uid(docs).alias("uid"), F.col("text").cast("string").alias("text"))
    return K.map_arrow(source, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, uid bigint, n_words bigint, hits {_HITS}")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """A row per document: doc_id, uid, n_words, n_hit, n_items, item_ids (sorted strings), contaminated, windows.

    ``windows`` are the benchmark windows that occur, as (first word, words).  A document is contaminated when it has
    hit words and they are at least one in ``share`` of its words.
    """
    wins = K.cut(windows_of_items(items, window))
    rows = K.cut(scan(docs, wins, window))
    hits = rows.where(F.size("hits") > 0).select("uid", F.inline("hits"))
    # Fingerprints meet; a hit holds if all words of the two windows are the same.
    own = wins.select("size", "fp", F.col("words").alias("item_words")).distinct()
    met = hits.join(own, ["size", "fp"]).where("words = item_words").select("uid", "start", "size", "words")
    met = K.cut(met)
    per = met.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("windows"))
    named = met.select("uid", "words").distinct().join(wins.select("words", F.col("item_id").cast("string").alias("item")).distinct(), "words").select("uid", "item").distinct()
    per = per.join(named.groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("item_ids")), "uid")
    # The union of the windows: carry the words covered and the end of what is covered along the sorted starts.
    covered = F.expr(
        """aggregate(windows, named_struct('n', 0L, 'end', 0), (a, x) -> named_struct(
             'n', a.n + greatest(0, x.start + x.size - greatest(x.start, a.end)),
             'end', greatest(a.end, x.start + x.size)), a -> a.n)"""
    )
    per = per.select("uid", "item_ids", "windows", covered.alias("n_hit"))
    out = rows.select("doc_id", "uid", "n_words").join(per, "uid", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint"))).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "uid",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        "item_ids",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "windows",
    )
