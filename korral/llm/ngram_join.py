"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row for each distinct shingle set and a column for
each shingle.  Copies share a row, so a group of copies is one row however
large it is.

1. ``incidence``: the columns are dealt to blocks, and each block adds up, for
   every row, the columns that it shares with any other row.  A row's overlap
   with any other is at most that sum, so a row below ``t * n`` links with
   nothing and goes.  Map tasks add up what repeats among their own rows, and send
   a column that several have as one mark: a column in a third of all rows is an
   entry per map buffer, not one per row.
2. The other rows' sets are read once more, without the columns that no other of
   them has, rarest column first (``by_rarity``).
3. Products are made of rows that have a leading column in common: of a row with s
   such columns the first ``s - ceil(t * n) + 1``, as any overlap that suffices
   takes one of them.  In a column, every row is first multiplied with its most
   central row alone, the pivot (a star), so a group of g near copies makes g
   products, not g * g.  The links found are closed into components.
4. Of rows in different components the product of the leading columns is added up
   by pair, under bounds from sizes and places before a pair is made and from what
   is counted and what is left after; the pairs above them are multiplied to the
   end, in blocks, with the same bound in between (``product``).

Nothing is capped: a pair is left out only if its rows are in one component
already or if a bound excludes it.

Exact up to collisions of hashes: shingles are compared by 58 bits, sets by 128.
Broadcast are only bitmaps (of the sets that have copies, and of the rows that
passed step 1) of a fixed size, at most 16 MB each; a full bitmap lets more rows
through and changes no result.

Edge cases: a text with fewer words than ``k`` is one shingle, a null or
wordless one has no set, ``n_shingles`` 0 and links with nothing.  Each input
row gives one row, also where a doc_id repeats or is null; a component's id is
its smallest non-null doc_id, which may be null or another component's too, so
``component`` (its smallest set key) tells components apart.  Other columns are
not read.  Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korral.llm import _kernel as K
from korral.llm.components import components

SHINGLE, PERCENT = 5, 75
#: Entries of the incidence in a block (the least, and the most where there are more than MANY_BLOCKS) and the least number of blocks.
BLOCK_ENTRIES, MANY_BLOCKS, BLOCKS = (1_000_000, 16_000_000), 8192, 12
#: Entries at which a map task's buffer is sent, and half the rows that it can number.
BUFFER, FLUSH_ROWS = 1_500_000, 1 << 15
MAX_BITS = 27
#: Columns of a pair's first block.
FIRST_COLUMNS = 128
_DEALT = pa.schema([("block", pa.int64()), ("flush", pa.int64()), *((c, pa.binary()) for c in ("rows", "n", "own", "cols", "idx", "keys", "marks"))])


def whole(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Every text is one row of the matrix."""
    return K.slices(text)


def _sets(text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """(first row, end row, and the shingle sets of the rows between)."""
    for lo, hi, data, offs in K.slices(text):
        yield lo, hi, *shingle_sets(data, offs, k)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of rows of bytes: shingles sorted and distinct within each row, how many each row has, and a 16-byte key of each row's set."""
    rows = len(offs) - 1
    if rows:
        s, e, row = K.word_spans(data, offs, K.NOT_SPACE)
        words = K.span_hash(data, s, e, K.LOWER)
        count = np.bincount(row, minlength=rows)
        own, grams = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(words) >= k:
            at = np.flatnonzero(row[: len(words) - k + 1] == row[k - 1 :])
            own, grams = row[at], K.gram_hash(words, k)[at]
        first = np.cumsum(count) - count
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            own = np.concatenate((own, few))
            grams = np.concatenate((grams, np.array([K.gram_hash(words[first[i] : first[i] + count[i]], int(count[i]))[0] for i in few], np.uint64)))
        order = K.order_in_rows(own, grams)
        own, grams = own[order], grams[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
        own, grams = own[new], grams[new]
        n = np.bincount(own, minlength=rows)
        a, b = K.set_hash(grams, n, 0), K.set_hash(grams, n, 0x5851F42D4C957F2D)
        raw = np.stack((a, b), 1).tobytes()
        return grams, n, [raw[i * 16 : i * 16 + 16] for i in range(rows)]
    return np.zeros(0, np.uint64), np.zeros(0, np.int64), []


def _keys(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, _, n, keys in _sets(b.column("text"), k):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("uid").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "uid", "n", "key"])


def _block(g: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, three bytes of the column in the block) of 64-bit columns; both follow their order.

    Columns of a block that agree in these count as one, which only lets more rows through.
    """
    low = g & np.uint64(0xFFFFFFFF)
    low *= np.uint64(blocks)
    low >>= np.uint64(32)
    x = g >> np.uint64(32)
    x *= np.uint64(blocks)
    x += low
    cols = x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 1:]  # of the lower half
    x >>= np.uint64(32)
    return x.view(np.int64), cols


def _deal(batches: Iterator[pa.RecordBatch], k: int, blocks: int, copied, split=whole) -> Iterator[pa.RecordBatch]:
    """The incidence by block, packed; what repeats within a flush is added up before it is sent.

    A flush numbers its rows. It sends one row with the rows' short keys, sizes and own counts (under a negative block),
    and for each block the columns that it holds once with their rows' numbers (those of rows that have copies come last,
    with the rows' keys), and once each the columns that several of its rows have (``marks``).
    """
    part = TaskContext.get().partitionId()
    grams: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    shorts: list[np.ndarray] = []
    held, rows, seen, number = 0, 0, set(), 0

    def flush() -> Iterator[pa.RecordBatch]:
        g, n, short = np.concatenate(grams), np.concatenate(sizes), np.concatenate(shorts)
        grams.clear()  # the largest arrays go as soon as they have been used
        row = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        order = np.argsort(g)
        g, row = g[order], row[order]
        del order
        again = np.zeros(len(g), bool)
        again[1:] = g[1:] == g[:-1]
        many = again.copy()
        many[:-1] |= again[1:]
        own = np.bincount(row[many], minlength=len(n)).astype(np.uint32)
        at = part << 24 | number
        out = [{"block": -1 - at % blocks, "flush": at, "rows": short.tobytes(), "n": n.astype(np.uint32).tobytes(), "own": own.tobytes()}]
        block, marks = _block(g[many & ~again], blocks)
        mark_at = np.searchsorted(block, np.arange(blocks + 1))
        g, row = g[~many], row[~many]
        twice = K.in_bitmap(copied.value, short)[row]
        own_at, parts = [], []
        for some in (~twice, twice):
            block, cols = _block(g[some], blocks)
            own_at.append(np.searchsorted(block, np.arange(blocks + 1)))
            parts.append((cols, row[some]))
        for i in range(blocks):
            (a, b), (c, d) = (x[i : i + 2] for x in own_at)
            if a < b or c < d or mark_at[i] < mark_at[i + 1]:
                out.append({"block": i, "flush": at, "cols": parts[0][0][a:b].tobytes() + parts[1][0][c:d].tobytes(), "idx": parts[0][1][a:b].tobytes() + parts[1][1][c:d].tobytes(),
                            "keys": short[parts[1][1][c:d]].tobytes(), "marks": marks[mark_at[i] : mark_at[i + 1]].tobytes()})
        for j in range(0, len(out), 256):
            yield pa.RecordBatch.from_pylist(out[j : j + 256], schema=_DEALT)

    for b in batches:
        for _, _, data, offs in split(b.column("text")):
            g, n, keys = shingle_sets(data, offs, k)
            short, first = np.frombuffer(b"".join(keys), np.uint64)[::2], np.cumsum(n) - n
            for lo in range(0, len(n), FLUSH_ROWS):
                hi = min(lo + FLUSH_ROWS, len(n))
                if held and (held >= BUFFER or rows + hi - lo > 2 * FLUSH_ROWS):
                    yield from flush()
                    grams, sizes, shorts, held, rows, seen, number = [], [], [], 0, 0, set(), number + 1
                new = []
                for i in range(lo, hi):
                    if n[i] and keys[i] not in seen:
                        seen.add(keys[i])
                        new.append(i)
                keep = np.zeros(len(n), bool)
                keep[new] = True
                end = first[hi - 1] + n[hi - 1]
                grams.append(g[first[lo] : end][np.repeat(keep[lo:hi], n[lo:hi])])
                sizes.append(n[new])
                shorts.append(short[new])
                held, rows = held + len(grams[-1]), rows + len(new)
    if held:
        yield from flush()


def _bytes(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in column.to_pylist()]


def _shared(table: pa.Table) -> pa.Table:
    """Of one block: for every row of every flush, how many of its columns a different row of another flush has, too."""
    if table.column("block")[0].as_py() < 0:
        return table.select(["flush", "rows", "n", "own"]).append_column("idx", pa.nulls(len(table), pa.binary())).append_column("credit", pa.nulls(len(table), pa.binary()))
    (cols, marks), idx, keys = (b"".join(table.column(c).to_pylist()) for c in ("cols", "marks")), _bytes(table.column("idx"), np.uint16), _bytes(table.column("keys"), np.uint64)
    size = np.array([len(x) for x in idx])
    flush = np.repeat(np.arange(len(idx), dtype=np.uint64), size)
    inst = flush << np.uint64(16) | np.concatenate(idx)
    # Who has a column: a row of a flush; a row that has copies is the same in all flushes; a mark stands for several rows.
    who = inst.copy()
    end = np.cumsum(size)
    for e, x in zip(end, keys, strict=True):
        who[e - len(x) : e] = x | np.uint64(1 << 63)
    col = np.zeros((len(cols) + len(marks)) // 3, "<u4")
    col.view(np.uint8).reshape(-1, 4)[:, :3] = np.frombuffer(cols + marks, np.uint8).reshape(-1, 3)
    who = np.concatenate((who, np.full(len(marks) // 3, (1 << 63) - 1, np.uint64)))
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    new = np.ones(len(col), bool)
    new[1:] = col[1:] != col[:-1]
    other = np.zeros(len(col), bool)
    other[1:] = ~new[1:] & (who[1:] != who[:-1])
    start = np.flatnonzero(new)
    several = np.logical_or.reduceat(other, start) if len(start) else other
    credited = order[np.repeat(several, np.diff(np.append(start, len(col))))]
    got = np.sort(inst[credited[credited < len(inst)]])
    at = np.flatnonzero(np.concatenate(([True], got[1:] != got[:-1]))) if len(got) else np.zeros(0, np.int64)
    credit, got = np.diff(np.append(at, len(got))), got[at]
    bound = np.searchsorted(got >> np.uint64(16), np.arange(len(idx) + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(bound))
    names = table.column("flush").to_numpy()
    low = (got & np.uint64(0xFFFF)).astype(np.uint16)
    none = pa.nulls(len(some), pa.binary())
    return pa.table({"flush": pa.array(names[some], pa.int64()), "rows": none, "n": none, "own": none,
                     "idx": pa.array([low[bound[i] : bound[i + 1]].tobytes() for i in some], pa.binary()), "credit": pa.array([credit[bound[i] : bound[i + 1]].astype(np.uint32).tobytes() for i in some], pa.binary())})


def _summed(table: pa.Table, percent: int) -> pa.Table:
    """Of one flush: the rows that reach ``percent`` of their columns, their own count and the blocks' added up."""
    told = [i for i, x in enumerate(table.column("rows").is_valid().to_pylist()) if x][0]
    rows, n, total = (np.frombuffer(table.column(c)[told].as_py(), t) for c, t in (("rows", np.uint64), ("n", np.uint32), ("own", np.uint32)))
    total = total.astype(np.int64)
    for idx, credit in zip(_bytes(table.column("idx"), np.uint16), _bytes(table.column("credit"), np.uint32), strict=True):
        total[idx] += credit  # a row is named once by a block
    keep = 100 * total >= percent * n.astype(np.int64)
    return pa.table({"short": pa.array(rows[keep].view(np.int64)), "shared": pa.array(total[keep])})


def incidence(docs: DataFrame, k: int, blocks: int, copied, percent: int, split=whole) -> DataFrame:
    """(short, shared) of the rows of which ``percent`` of the columns occur in other rows; a row may be listed again."""
    packed = "block bigint, flush bigint, rows binary, n binary, own binary, cols binary, idx binary, keys binary, marks binary"
    dealt = K.map_arrow(docs.select("text"), lambda it: _deal(it, k, blocks, copied, split), packed)
    parts = K.group_arrow(dealt, "block", _shared, "flush bigint, rows binary, n binary, own binary, idx binary, credit binary")
    return K.group_arrow(parts, "flush", lambda t: _summed(t, percent), "short bigint, shared bigint")


def _read(batches: Iterator[pa.RecordBatch], k: int, bits, split=whole) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, offs in split(b.column("text")):
            g, n, keys = shingle_sets(data, offs, k)
            short = np.frombuffer(b"".join(keys), np.uint64)[::2]
            keep = K.in_bitmap(bits.value, short) & (n > 0)
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.binary()), pa.array(short[at].view(np.int64)), pa.array(n[at], pa.int64()), K.lists(g[np.repeat(keep, n)].view(np.int64), n[at], pa.int64())], ["key", "short", "n", "cols"])


def _need(n: str, m: str, p: int) -> str:
    """The least overlap i of sets of n and m with 100 * i >= p * (n + m - i)."""
    return f"ceil({p} * ({n} + {m}) / {100 + p}D)"


def similar_sets(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row per document with its set's key and size, the ids of keys, the component of every id that is linked)."""
    source = docs.select("doc_id", K.uid(docs).alias("uid"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = K.cut(K.map_arrow(source, lambda it: _keys(it, k), f"doc_id {kind}, uid bigint, n bigint, key binary"))
    held, sets = repeated_sets(source, rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.count("*").alias("copies")), k, percent)
    ranked = by_rarity(sets, percent)
    post = ranked.select("id", "n", "s", F.posexplode(F.slice("cols", F.lit(1), _room("s", "n", percent))).alias("pos", "col"))

    # Stars: every row times the most central row, the pivot, of each of its leading columns.
    central = F.max(F.struct((F.col("s") / F.col("n")).alias("rank"), "id", "n", "s", "pos")).alias("c")
    pivots = post.groupBy("col").agg(central, F.count("*").alias("rows")).where("rows > 1")
    pivots = pivots.select("col", *(F.col(f"c.{x}").alias(f"{x}2") for x in ("id", "n", "s", "pos")))
    met = post.join(pivots, "col").where(f"id <> id2 and {_can(percent)}")
    met = met.select(F.least("id", "id2").alias("id"), F.greatest("id", "id2").alias("id2")).distinct()
    links = product(met.withColumns({"seen": F.lit(0), "pos": F.lit(-1), "pos2": F.lit(-1)}), ranked, percent)
    label = K.cut(_labels(links))

    # The product of the leading columns, of rows that the stars have left in different components. Of a pair, the
    # smaller row needs only the columns before which it can't have missed too many even for a partner of its size.
    seats = post.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = seats.groupBy("col").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("col")
    seats = K.cut(seats.join(mixed, "col"))
    small = seats.where(F.expr(f"pos <= s - {_need('n', 'n', percent)}"))
    large = seats.select("col", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "s", "pos", "label")))
    # The first column that a pair has in common leaves it room enough; so do all before a column that does.
    room = f"least(n, n2) * 100 >= {percent} * greatest(n, n2) and least(s - pos, s2 - pos2) >= {_need('n', 'n2', percent)}"
    pairs = small.join(large, "col").where(f"label <> label2 and (n < n2 or n = n2 and id < id2) and {room}")
    pairs = pairs.groupBy("id", "id2", "n", "n2", "s", "s2").agg(F.count("*").alias("seen"), F.max("pos").alias("pos"), F.max("pos2").alias("pos2"))
    # A common column that isn't counted yet comes after the last one that is, in both rows.
    pairs = pairs.where(f"seen + least(s - pos - 1, s2 - pos2 - 1) >= {_need('n', 'n2', percent)}")
    rest = K.cut(product(pairs, ranked, percent))
    if not rest.isEmpty():
        own = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
        rest = rest.join(own("id"), "id", "left").join(own("id2"), "id2", "left")
        rest = rest.select("id", "id2", F.coalesce("id_label", "id").alias("a"), F.coalesce("id2_label", "id2").alias("b"))
        far = _labels(rest.select(F.col("a").alias("id"), F.col("b").alias("id2"))).select(F.col("id").alias("label"), F.col("label").alias("far"))
        every = label.union(rest.select("id", "a")).union(rest.select("id2", "b")).distinct()
        label = every.join(far, "label", "left").select("id", F.coalesce("far", "label").alias("label"))
    return rows, held.select("key", "id"), label


def repeated_sets(source: DataFrame, sizes: DataFrame, k: int, percent: int, split=whole) -> tuple[DataFrame, DataFrame]:
    """The rows that can reach the threshold with any other: (key, short, id, n), and (id, n, cols).

    ``sizes`` has the key, n and copies of every different set; ``split`` cuts a text column into rows.
    """
    spark = source.sparkSession
    sizes = sizes.select("key", "n", "copies", _short("key").alias("short"))
    total, copied = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("copies") > 1)).first()
    blocks = max(BLOCKS, -(-int(total) // min(BLOCK_ENTRIES[1], max(BLOCK_ENTRIES[0], int(total) // MANY_BLOCKS))))
    bits = spark.sparkContext.broadcast(K.bitmap(sizes.where("copies > 1"), "short", K.bitmap_bits(copied, MAX_BITS)))
    shared = incidence(source, k, blocks, bits, percent, split).select("short").distinct()
    # Where two keys share their front (practically never), ids are of the whole key.
    held = K.cut(sizes.select("key", "n", F.col("short").alias("id")).join(shared, F.col("id") == F.col("short")))
    facts = held.agg(F.count("*"), F.count_distinct("id")).first()
    if facts[0] != facts[1]:
        held = held.withColumn("id", F.xxhash64("key"))
    bits = spark.sparkContext.broadcast(K.bitmap(held, "short", K.bitmap_bits(facts[0], MAX_BITS)))
    read = K.map_arrow(source.select("text"), lambda it: _read(it, k, bits, split), "key binary, short bigint, n bigint, cols array<bigint>")
    sets = read.groupBy("key").agg(F.first("cols").alias("cols")).join(held.select("key", "id", "n"), "key")
    return held, K.cut(sets.select("id", "n", "cols"))


def by_rarity(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, s, cols) of the rows that still can reach the threshold: their s columns that other rows have, too, rarest first."""
    each = sets.select("id", "n", F.explode("cols").alias("col"))
    # A column's place in the order is the power of two of its degree, then its hash (the front 58 bits).
    rarity = F.shiftleft(F.log2(F.count("*")).cast("bigint"), 58).bitwiseOR(F.shiftrightunsigned("col", 6))
    many = each.groupBy("col").agg(F.count("*").alias("df"), rarity.alias("token")).where("df > 1").select("col", "token")
    ranked = each.join(many, "col").groupBy("id", "n").agg(F.sort_array(F.collect_list("token")).alias("cols"))
    ranked = ranked.select("id", "n", F.size("cols").cast("bigint").alias("s"), "cols")
    return K.cut(ranked.where(100 * F.col("s") >= percent * F.col("n")))


def _room(s: str, n: str, percent: int) -> Column:
    """How many leading columns a row needs: any overlap that suffices for it takes one of these."""
    return F.expr(f"cast({s} - ceil({percent} * {n} / 100D) + 1 as int)")


def _can(percent: int) -> str:
    """Length and positional bound of a pair with a column in common: what both can have before it, and from it on."""
    return f"least(n, n2) * 100 >= {percent} * greatest(n, n2) and least(pos, pos2) + least(s - pos, s2 - pos2) >= {_need('n', 'n2', percent)}"


def _linked(percent: int) -> str:
    return f"100 * overlap >= {percent} * (n + n2 - overlap)"


def product(pairs: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, id2) that link, of pairs of which ``seen`` common columns are counted up to places pos and pos2.

    The other columns follow in two blocks, rarest first: after the first a pair goes if what is counted and all that is
    left can't suffice.
    """
    a = ranked.select("id", "n", "s", F.col("cols").alias("a"))
    b = ranked.select(*(F.col(c).alias(f"{c}2") for c in ("id", "n", "s")), F.col("cols").alias("b"))
    both = pairs.select("id", "id2", "seen", "pos", "pos2").join(a, "id").join(b, "id2")
    both = both.withColumns({"a": F.expr("slice(a, cast(pos + 2 as int), size(a))"), "b": F.expr("slice(b, cast(pos2 + 2 as int), size(b))")})
    first = f"seen + size(array_intersect(slice(a, 1, {FIRST_COLUMNS}), b))"
    both = both.withColumn("first", F.expr(first))
    both = both.where(f"first + least(greatest(size(a) - {FIRST_COLUMNS}, 0), size(b)) >= {_need('n', 'n2', percent)}")
    both = both.withColumn("overlap", F.expr(f"first + if(size(a) > {FIRST_COLUMNS}, size(array_intersect(slice(a, {FIRST_COLUMNS + 1}, size(a)), b)), 0)"))
    return both.where(_linked(percent)).select("id", "id2")


def _labels(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("id").alias("a"), F.col("id2").alias("b"))).select(F.col("node").alias("id"), "label")


def _short(key: str):
    """The key's first 8 bytes as the little-endian bigint that the workers use."""
    return F.expr(f"cast(conv(concat({', '.join(f'hex(substring({key}, {i}, 1))' for i in range(8, 0, -1))}), 16, -10) as bigint)")


def ngram_join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, uid, n_shingles, component_id (the smallest doc_id reachable by links), component (its own key, null without words)."""
    rows, ids, label = similar_sets(docs, k, percent)
    group = K.cut(label.join(ids, "id").select("key", "label"))
    sets = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    low = group.join(sets, "key").groupBy("label").agg(F.min("low").alias("component_id"), F.min("key").alias("component"))
    linked = group.join(low, "label").select("key", "component_id", "component")
    found = sets.join(linked, "key", "left").select("key", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("component", "key").alias("component"))
    out = rows.join(found, "key", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "uid", F.col("n").alias("n_shingles"), own.alias("component_id"), "component")
