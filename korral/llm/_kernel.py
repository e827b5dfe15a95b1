"""Vectorised text kernels over Arrow string columns, and job helpers.

The kernels treat a slice of a batch as one byte array, so tokenising and
hashing cost a few numpy passes per byte rather than a Python call per word.
Slices are cut at about ``SLICE_BYTES`` of text (a longer single text is a
slice of its own), which bounds a worker's memory whatever the batch holds.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from korral.sources.tree import shared_folder

SLICE_BYTES = 1 << 19
#: About the bytes of an Arrow batch (a longer single row is a batch of its own), and the setting for it.
BATCH_BYTES, _BATCH = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"

_U = np.uint64
_RNG = np.random.default_rng(20240611)
#: One random odd 64-bit value per byte: the alphabet of the word hash.
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15 | 3)
#: Odd multipliers for the positions of a k-gram.
_GRAM = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)

#: Bytes of words, as tables over all 256 byte values.  UTF-8 bytes of
#: non-ASCII characters are all >= 0x80, so both classes can be decided bytewise.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each row in the bytes); null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "").cast(pa.large_string())
    n = len(text)
    if not n:
        return
    _, off, data = text.buffers()
    offs = np.frombuffer(off, np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of word bytes; runs stop at row ends."""
    m = word[data]
    before, after = np.empty_like(m), np.empty_like(m)
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, z
    before[0], before[1:] = False, m[:-1]
    after[-1], after[:-1] = False, m[1:]
    cut = offs[1:-1]
    before[cut[cut < len(m)]] = False
    after[cut[cut > 0] - 1] = False
    start, end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LONG = 1024


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of the bytes of each span: eight bytes of all spans at a time."""
    if not len(start):
        return np.zeros(0, np.uint64)
    text = np.zeros(len(data) + 8, np.uint8)
    text[: len(data)] = data if fold is None else fold[data]
    window = np.ndarray((len(data) + 1,), np.dtype("<u8"), text, strides=(1,))  # the eight bytes from each byte on
    size = end - start
    out = mix(mix(size.astype(np.uint64)) + (window[start] & _LOW_BYTES[np.minimum(size, 8)]))
    long, at = np.flatnonzero(size > 8), 8
    while len(long) and at < _LONG:
        out[long] = mix(out[long] * _BASE + (window[start[long] + at] & _LOW_BYTES[np.minimum(size[long] - at, 8)]))
        at += 8
        long = long[size[long] > at]
    for i in long:  # spans over a kilobyte
        out[i] ^= np.frombuffer(hashlib.blake2b(text[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


def value_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, cuts: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of spans of 64-bit values, and of their fronts of ``cuts`` values (0 where a span is no longer than the cut)."""
    if not len(start):
        z = np.zeros(0, np.uint64)
        return z, [z for _ in cuts]
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    run = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(values[np.repeat(start, size) + at] * _powers(int(size.max()))[at], out=run[1:])
    base = run[first]
    fronts = []
    for k in cuts:
        long = size > k
        h = np.zeros(len(start), np.uint64)
        h[long] = mix(run[first[long] + k] - base[long] + _U(k + (1 << 32)))
        fronts.append(h)
    return mix(run[first + size] - base + size.astype(np.uint64)), fronts


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for every i with a whole k-gram (rows are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _GRAM[j % 64] if j < 64 else mix(words[j : j + n] + _U(j))
    return mix(out)


def set_hash(values: np.ndarray, count: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the set of values of each row (count[i] distinct ones in row i, in any order)."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count > 0)
    if len(some):
        start = np.cumsum(count) - count
        out[some] = mix(np.add.reduceat(mix(values ^ _U(salt)), start[some]) + count[some].astype(np.uint64))
    return out


def order_in_rows(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by row, then value."""
    if len(row) and row.max() < 1 << 16:  # a radix sort of what the faster sort by value has left
        first = np.argsort(values)
        return first[np.argsort(row[first].astype(np.uint16), kind="stable")]
    return np.lexsort((values, row))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with counts[i] values in row i."""
    offs = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def bitmap_bits(n: int, most: int) -> int:
    """log2 of the bits of a bitmap for n values: 64 a value, within a fixed bound."""
    return int(min(most, max(15, np.ceil(np.log2(max(n, 1) * 64)))))


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Membership bitmap of 2 ** bits bits over the low bits of a bigint column, built on the executors."""
    # Spark's buckets hold the values 1..32768, 32769..65536 and so on, in 4096 bytes each.
    slot = F.expr(f"({column} & {(1 << bits) - 1}L) + 1")
    rows = df.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        at = (int(r.b) - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x & np.uint64(len(bits) * 8 - 1)
    return (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def shared_dir(spark: SparkSession) -> None:
    """Make reliable checkpoints possible."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: computed once, and safe when executors are lost.

    Meanwhile Arrow batches are of ``BATCH_BYTES``: a batch is held by the executor and by its worker, which may have two.
    """
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_BATCH, None)
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return df.checkpoint(eager=True)
    finally:
        if before is None:
            conf.unset(_BATCH)
        else:
            conf.set(_BATCH, before)


def _bare_source(docs: DataFrame) -> str | None:
    """"files" or "checkpoint" if the rows are all those of one of these, with columns chosen or cast at most."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    kind = plan.getClass().getSimpleName()
    if kind == "LogicalRelation" and "_metadata" not in docs.columns:
        return "files"
    return "checkpoint" if kind == "LogicalRDD" and plan.rdd().isCheckpointed() else None


def _file_uid(docs: DataFrame) -> Column | None:
    """The row's place in its file, under a hash of the file that is checked to differ between the files."""
    place = F.col("_metadata.row_index")
    try:
        files = docs.select(F.col("_metadata.file_path").alias("file"), place.alias("row")).groupBy("file").agg(F.max("row").alias("last"))
    except AnalysisException:  # not a format that numbers its rows
        return None
    bits = max(1, int(files.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]).bit_length())
    salted = [(lambda file, salt=salt: F.shiftrightunsigned(F.xxhash64(file, F.lit(salt)), bits + 1)) for salt in range(4)]
    n, *different = files.agg(F.count("*"), *(F.count_distinct(h(F.col("file"))) for h in salted)).first()
    for h, d in zip(salted, different, strict=True):
        if d == n:
            return F.shiftleft(h(F.col("_metadata.file_path")), bits) + place
    return None


def fixed(docs: DataFrame) -> DataFrame:
    """The documents in a form whose rows every scan numbers alike: as they are if they are Parquet files or a checkpoint, else checkpointed."""
    source = _bare_source(docs)
    return docs if source == "checkpoint" or source == "files" and _file_uid(docs) is not None else cut(docs)


def uid(docs: DataFrame) -> Column:
    """A bigint for each row of :func:`fixed` documents, the same in every scan.

    Spark's own row numbers depend on how a scan is split, which follows the cores at hand: two scans of the
    same files may differ when an executor is lost or joins. Of files, the file and the row's place in it are
    taken (rows of one file in their order); a checkpoint's partitions are files of their own.
    """
    place = _file_uid(docs) if _bare_source(docs) == "files" else None
    return F.monotonically_increasing_id() if place is None else place


def give_back() -> None:
    """Return what this process has freed to the system: allocators keep it, and a worker waits for its next task with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # not every libc can
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose workers give their memory back at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def group_arrow(df: DataFrame, key: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``applyInArrow`` by a column, whose workers give their memory back after each group."""

    def group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return df.groupBy(key).applyInArrow(group, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
