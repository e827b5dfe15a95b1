"""Line dedup by an exact set-similarity join.

A line is the set of its distinct words (A-Z in lower case).  Lines with equal
sets are one record, which stands at the first of them.  A record's tokens are
ordered by rarity, rarest first; two records that reach the threshold have one
of their first ``n - ceil(t * n) + 1`` tokens, their prefixes, in common.  Records
that meet in a prefix token pass the length filter and the positional filter
(what stands from the shared token on must suffice), and a filter of 128 bits (the
parities of the tokens' hashes differ in no more bits than the sets may differ
in tokens); then their exact Jaccard similarity is verified.  Every line but the
first of its record is removed, and the first as well if it matches a line that
comes earlier in the corpus (by doc_id, row, place in the text).

Rarity is counted over all words in a table of ``2 ** SLOTS`` counts, so words
share counts; that changes the order, which any fixed one may be, not the result.
Tokens are 44 bits of rarity and hash; words that share one only meet more often.

Each prefix token is first met by its earliest record alone (a star); only
records that this leaves unmatched meet all earlier ones, so a family of near
copies of one line doesn't make all its pairs.

Scale: texts never move.  What is shuffled are a row per line for its record and
the packed prefixes, 36 bytes a token before compression; a block of tokens hands on only the
entries that the filters leave a partner.  A map task sends a record once, so
a token has an entry for each record and map buffer at most.  Broadcast are the
counts (``8 << SLOTS`` bytes) and one bitmap of at most 16 MB.

Exact up to collisions of hashes: words are compared by 64 bits, lines by 128.

Edge cases: lines end at \\n; blank lines match nothing and stay; null texts have
no line.  Each input row gives one row, null doc_ids come last, and rows that
repeat a doc_id follow each other.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korral.llm import _kernel as K
from korral.llm.ngram_join import MAX_BITS, PERCENT, _linked, _need

SLOTS = 16
#: Parts of the table of counts, each of which is added up by itself.
PARTS = 256
#: Entries of the prefixes in a block, the least number of blocks, and entries in a map task's buffer.
BLOCK_ENTRIES, BLOCKS, BUFFER = 500_000, 12, 500_000
#: Words of 64 parities that are compared before the words themselves.
PARITIES = 4
_WIDE = tuple(f"p{i}" for i in range(PARITIES))
_ENTRY = {"token": "<u4", "n": "<u4", "pos": "<u4", "id": "<u8", "low": "<u8", "high": "<u8"}  # two words of 64 parities
_BYTES = sum(np.dtype(kind).itemsize for kind in _ENTRY.values())
#: Bits of a token: of its slot's rank, then of its hash. The bits above hold the line while a slice is sorted.
TOKEN_BITS = 44


def _cut_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the lines, row of each line, place of each line in its row); an empty text has no line."""
    ends = np.flatnonzero(data == 10)
    some = np.flatnonzero(np.diff(offs) > 0)
    # A line starts with each filled text, and after each line end: in the same text, even if nothing follows there.
    start = np.concatenate((offs[some], ends + 1))
    row = np.concatenate((some, np.searchsorted(offs, ends, side="right") - 1))
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    first = np.searchsorted(row, row, side="left")
    return np.append(start, len(data)), row, np.arange(len(row)) - first


def _sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines: (words as they stand, distinct words sorted within each line, their lines, how many each line has, two hashes of each line's set)."""
    s, e, own = K.word_spans(data, at, K.NOT_SPACE)
    h = K.span_hash(data, s, e, K.LOWER)
    words = _in_lines(own, h, len(at) - 1)
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (words[1:] != words[:-1])
    own, words = own[new], words[new]
    n = np.bincount(own, minlength=len(at) - 1)
    keys, some = np.zeros((len(n), 2), np.uint64), n > 0
    if len(words):
        first, size, one = (np.cumsum(n) - n)[some], n[some].astype(np.uint64), K.mix(words)
        two = (one ^ one >> np.uint64(29)) * np.uint64(0x5851F42D4C957F2D)
        for i, x in enumerate((one, two ^ two >> np.uint64(32))):
            keys[some, i] = K.mix(np.add.reduceat(x, first) + size)
    return h, words, own, n, keys


def _in_lines(own: np.ndarray, words: np.ndarray, lines: int) -> np.ndarray:
    """The words sorted within each line; lines stand in order."""
    bits = np.uint64(max(1, lines.bit_length()))
    key = own.astype(np.uint64) << np.uint64(64) - bits | words >> bits
    order = np.argsort(key)  # one sort of one value, unless it leaves different words apart
    key, out = key[order], words[order]
    return words[K.order_in_rows(own, words)] if ((key[1:] == key[:-1]) & (out[1:] != out[:-1])).any() else out


def _tokens(own: np.ndarray, words: np.ndarray, lines: int, rarity: np.ndarray) -> np.ndarray:
    """The words' tokens, rarest first within each line; lines stand in order. Words that share a token only meet more often."""
    token = rarity[_slot(words)] | words >> np.uint64(64 - TOKEN_BITS + SLOTS)
    if lines >> 64 - TOKEN_BITS:
        return token[np.lexsort((token, own))]
    token |= own.astype(np.uint64) << np.uint64(TOKEN_BITS)
    token.sort()
    return token & np.uint64((1 << TOKEN_BITS) - 1)


def _packed(entries: dict[str, np.ndarray], lo: int, hi: int) -> bytes:
    """Entries sorted by token as bytes: column by column, sizes and places byte by byte, so that the shuffle's compression finds what repeats."""
    return b"".join((x[lo:hi].view(np.uint8).reshape(-1, 4).T if c in ("n", "pos") else x[lo:hi]).tobytes() for c, x in entries.items())


def _unpacked(parts: list[bytes]) -> dict[str, np.ndarray]:
    out, lo = {c: np.empty(sum(map(len, parts)) // _BYTES, kind) for c, kind in _ENTRY.items()}, 0
    for raw in parts:
        m, at = len(raw) // _BYTES, 0
        for c, x in out.items():
            size = x.itemsize
            if c in ("n", "pos"):
                x[lo : lo + m].view(np.uint8).reshape(m, 4)[:] = np.frombuffer(raw, np.uint8, m * 4, at).reshape(4, m).T
            else:
                x[lo : lo + m] = np.frombuffer(raw, _ENTRY[c], m, at)
            at += m * size
        lo += m
    return out


def _slot(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64((1 << SLOTS) - 1)).astype(np.int64)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per line that has words, a row per document (n_lines), and at the end the words' counts by slot, in parts."""
    counts, kind = np.zeros(1 << SLOTS, np.int64), None
    names = ["doc_id", "uid", "line", "n", "key", "key2", "n_lines", "part", "counts"]
    nothing = lambda m, *kinds: (pa.nulls(m, k) for k in kinds)
    for b in batches:
        kind = b.schema.field("doc_id").type
        for lo, hi, data, offs in K.slices(b.column("text")):
            at, row, place = _cut_lines(data, offs)
            n_lines = pa.array(np.bincount(row, minlength=hi - lo), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("uid").slice(lo, hi - lo), *nothing(hi - lo, pa.int32(), pa.int64(), pa.int64(), pa.int64()), n_lines, *nothing(hi - lo, pa.int32(), pa.list_(pa.int64()))], names)
            words, _, _, n, keys = _sets(data, at)
            counts += np.bincount(_slot(words), minlength=1 << SLOTS)
            some = np.flatnonzero(n)
            take, key = pa.array(lo + row[some]), keys[some].view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("uid").take(take), pa.array(place[some], pa.int32()), pa.array(n[some], pa.int64()),
                                              pa.array(key[:, 0]), pa.array(key[:, 1]), *nothing(len(some), pa.int64(), pa.int32(), pa.list_(pa.int64()))], names)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([*nothing(PARTS, kind, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), pa.array(np.arange(PARTS), pa.int32()), K.lists(counts, np.full(PARTS, (1 << SLOTS) // PARTS), pa.int64())], names)


def _added(table: pa.Table) -> pa.Table:
    """The sum of the counts of one part."""
    counts = table.column("counts").combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(0)
    return pa.table({"part": table.column("part")[:1], "counts": K.lists(counts, np.array([len(counts)]), pa.int64())})


def _deal(batches: Iterator[pa.RecordBatch], blocks: int, counts, percent: int) -> Iterator[pa.RecordBatch]:
    """The prefixes by block of tokens, packed by :func:`_packed`; a record is sent once by a buffer."""
    rarity = np.empty(1 << SLOTS, np.uint64)
    rarity[np.argsort(counts.value, kind="stable")] = np.arange(1 << SLOTS, dtype=np.uint64) << np.uint64(TOKEN_BITS - SLOTS)
    prefixes: list[tuple[np.ndarray, ...]] = []
    lines: list[tuple[np.ndarray, ...]] = []
    held, sent, seen = 0, 0, set()

    def flush() -> Iterator[pa.RecordBatch]:
        token, pos, line = (np.concatenate(x) for x in zip(*prefixes, strict=True))
        block = (token >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
        key = block << np.uint64(32) | token & np.uint64(0xFFFFFFFF)
        order = np.argsort(key)
        key, line = key[order], line[order]
        n, ids, low, high = (np.concatenate(x)[line] for x in zip(*lines, strict=True))
        entries = dict(zip(_ENTRY, (key.astype(np.uint32), n, pos[order], ids, low, high), strict=True))
        bound = np.searchsorted(key, np.arange(blocks + 1, dtype=np.uint64) << np.uint64(32))
        some = np.flatnonzero(np.diff(bound))
        for lo in range(0, len(some), 256):
            x = some[lo : lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array([_packed(entries, bound[i], bound[i + 1]) for i in x], pa.binary())], ["block", "entries"])

    for b in batches:
        for _, _, data, offs in K.slices(b.column("text")):
            at, _, _ = _cut_lines(data, offs)
            _, words, own, n, keys = _sets(data, at)
            raw, keep = keys.tobytes(), np.zeros(len(n), bool)
            for i in np.flatnonzero(n * (100 - percent) >= max(percent, 1)).tolist():  # smaller sets match equal ones only, which are the same record
                key = raw[i * 16 : i * 16 + 16]
                if key not in seen:
                    seen.add(key)
                    keep[i] = True
            words, n, ids = words[keep[own]], n[keep], keys[keep, 0]
            if len(words):
                own, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                one = np.uint64(1) << (words >> np.uint64(57) & np.uint64(63))
                both, low = np.bitwise_xor.reduceat(one, first), np.bitwise_xor.reduceat(np.where(words >> np.uint64(63) > 0, np.uint64(0), one), first)
                token = _tokens(own, words, len(n), rarity)
                size = np.minimum(n + (-percent * n // 100) + 1, n)  # of the prefixes
                line = np.repeat(np.arange(len(n)), size)
                pos = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
                token = token[first[line] + pos]
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])  # of words that share a token, the first
                prefixes.append((K.mix(token[new]), pos[new].astype(np.uint32), line[new] + sent))
                lines.append((n.astype(np.uint32), ids, low, both ^ low))
                held, sent = held + len(token), sent + len(n)
            if held >= BUFFER:
                yield from flush()
                prefixes, lines, held, sent, seen = [], [], 0, 0, set()
    if held:
        yield from flush()


def _partners(table: pa.Table, percent: int) -> pa.Table:
    """Of one block: the entries (token, id, n, pos) that the filters leave a partner of the same token.

    Entries of a token stand by size. Each is compared with the next one, the one after that and so on, as long as sizes
    allow and as one of the two still has no partner: a family of near copies is told by its neighbours.
    """
    block = table.column("block")[0].as_py()
    e = _unpacked(table.column("entries").to_pylist())
    token = e["token"].astype(np.uint64) << np.uint64(32)
    if not len(token) or e["n"].max() >> 16:
        order = np.lexsort((e["id"], e["n"], token))
    else:  # one sort of one value; a record sent twice that it leaves apart is compared with itself, which only keeps it
        order = np.argsort(token | e["n"].astype(np.uint64) << np.uint64(16) | e["id"] >> np.uint64(48))
    token, ids, n, pos = token[order], e["id"][order], e["n"][order].astype(np.int64), e["pos"][order].astype(np.int64)
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])  # a record that several buffers sent
    if not new.all():
        order, token, ids, n, pos = order[new], token[new], ids[new], n[new], pos[new]
    left, low, high = n - pos, e["low"][order], e["high"][order]
    most = np.minimum(100 * n // max(percent, 1), (1 << 32) - 1).astype(np.uint64)
    ahead = np.searchsorted(token | n.astype(np.uint64), token | most, side="right") - 1 - np.arange(len(order))  # entries that sizes allow
    found = np.zeros(len(order), bool)
    i, step = np.arange(len(order)), 1
    while len(i := i[ahead[i] >= step]):
        a = i[~(found[i] & found[i + step])]
        b = a + step
        need = -(-percent * (n[a] + n[b]) // (100 + percent))
        ok = np.minimum(left[a], left[b]) >= need
        a, b, need = a[ok], b[ok], need[ok]
        ok = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b]) <= n[a] + n[b] - 2 * need
        found[a[ok]] = found[b[ok]] = True
        step += 1
    return pa.table({"token": pa.array((block << 32) + (token[found] >> np.uint64(32)).astype(np.int64)), "id": pa.array(ids[found].view(np.int64)), "n": pa.array(n[found].astype(np.int32)), "pos": pa.array(pos[found].astype(np.int32)),
                     "low": pa.array(low[found].view(np.int64)), "high": pa.array(high[found].view(np.int64))})


def _spot(uid: Column, line: Column) -> Column:
    """A value for a line's place, the same as in :func:`_read`; several places may have one."""
    wide = line.cast("bigint")
    return uid.bitwiseXOR(F.shiftrightunsigned(uid, 27)).bitwiseXOR(F.shiftleft(wide, 9)).bitwiseXOR(F.shiftleft(wide, 18))


def _read(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """(uid, line, words, their parities) of the lines whose places the bitmap names; other lines are only cut."""
    for b in batches:
        uids = b.column("uid").to_numpy(zero_copy_only=False).view(np.uint64)
        for lo, _, data, offs in K.slices(b.column("text")):
            at, row, place = _cut_lines(data, offs)
            uid, line = uids[lo + row], place.astype(np.uint64)
            some = np.flatnonzero(K.in_bitmap(bits.value, uid ^ uid >> np.uint64(27) ^ line << np.uint64(9) ^ line << np.uint64(18)))
            size = at[some + 1] - at[some]
            own = np.concatenate(([0], np.cumsum(size)))
            _, words, _, n, _ = _sets(data[np.arange(own[-1]) + np.repeat(at[some] - own[:-1], size)], own)
            some, n = some[n > 0], n[n > 0]
            if len(some):
                one, part = np.uint64(1) << (words >> np.uint64(52) & np.uint64(63)), (words >> np.uint64(58)) % np.uint64(PARITIES)
                first = np.cumsum(n) - n
                wide = [pa.array(np.bitwise_xor.reduceat(np.where(part == i, one, np.uint64(0)), first).view(np.int64)) for i in range(PARITIES)]
                yield pa.RecordBatch.from_arrays([pa.array(uid[some].view(np.int64)), pa.array(place[some], pa.int32()), K.lists(words.view(np.int64), n, pa.int64()), *wide], ["uid", "line", "words", *_WIDE])


def _source(docs: DataFrame) -> DataFrame:
    docs = K.fixed(docs)
    return docs.select("doc_id", K.uid(docs).alias("uid"), F.col("text").cast("string").alias("text"))


def _tell(source: DataFrame) -> DataFrame:
    """What :func:`_lines` says of documents."""
    kind = source.schema["doc_id"].dataType.simpleString()
    return K.cut(source.mapInArrow(_lines, f"doc_id {kind}, uid bigint, line int, n bigint, key bigint, key2 bigint, n_lines bigint, part int, counts array<bigint>"))


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(uid, line) of every line that goes; uid is the row's number in these documents, or in K.fixed ones made of them."""
    source = _source(docs)
    return _removed(source, _tell(source), percent)


def _removed(source: DataFrame, told: DataFrame, percent: int) -> DataFrame:
    spark = source.sparkSession
    counts = np.zeros((PARTS, (1 << SLOTS) // PARTS), np.int64)
    for r in told.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_added, "part int, counts array<bigint>").collect():
        counts[r.part] = r.counts
    rows = told.where("key is not null").select("doc_id", "uid", "line", "n", "key", "key2")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "line")
    records = K.cut(rows.groupBy("key", "key2").agg(F.min(at).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n")))
    entries = records.agg(F.coalesce(F.sum(F.expr(f"n - ceil({percent} * n / 100D) + 1")), F.lit(0)).cast("bigint")).first()[0]
    blocks = max(BLOCKS, -(-int(entries) // BLOCK_ENTRIES))
    order = spark.sparkContext.broadcast(counts.ravel())
    dealt = source.select("text").mapInArrow(lambda it: _deal(it, blocks, order, percent), "block bigint, entries binary")
    post = K.cut(dealt.groupBy("block").applyInArrow(lambda t: _partners(t, percent), "token bigint, id bigint, n int, pos int, low bigint, high bigint"))

    # The records with a partner, numbered in the order of the corpus. Where two keys share their front (practically
    # never) both are met under it.
    held = records.select(F.col("key").alias("id"), "first").join(post.select("id").distinct(), "id")
    held = K.cut(held)  # sorting reads it twice
    held = K.cut(held.orderBy("first").select("id", F.col("first.uid").alias("uid"), F.col("first.line").alias("line"), F.monotonically_increasing_id().alias("at")))
    spots = held.select(_spot(F.col("uid"), F.col("line")).alias("spot"))
    bits = spark.sparkContext.broadcast(K.bitmap(spots, "spot", K.bitmap_bits(held.count(), MAX_BITS)))
    words = source.select("uid", "text").mapInArrow(lambda it: _read(it, bits), f"uid bigint, line int, words array<bigint>, {', '.join(f'{c} bigint' for c in _WIDE)}")
    sets = K.cut(held.select("uid", "line", "at").join(words, ["uid", "line"]).drop("uid", "line"))
    met = ("at", "n", "pos", "low", "high")
    post = K.cut(post.join(held.select("id", "at"), "id").select("token", *met))  # read three times

    star = post.groupBy("token").agg(F.min(F.struct(*met)).alias("c"))
    star = star.select("token", *(F.col(f"c.{x}").alias(f"{x}2") for x in met))
    late = K.cut(_matched(post.join(star, "token"), sets, percent))
    open_ = post.join(late, "at", "left_anti")
    other = post.select("token", *(F.col(x).alias(f"{x}2") for x in met))
    late = late.union(_matched(open_.join(other, "token"), sets, percent)).distinct()

    firsts = held.join(late, "at", "left_semi").select("uid", "line")
    again = rows.join(records.where("copies > 1").select("key", "key2", "first"), ["key", "key2"]).where("not (uid = first.uid and line = first.line)").select("uid", "line")
    return firsts.union(again)


def _matched(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Numbers of the records that match an earlier one, of the pairs that meet in a token."""
    need = _need("n", "n2", percent)
    filters = f"at2 < at and least(n, n2) * 100 >= {percent} * greatest(n, n2) and least(n - pos, n2 - pos2) >= {need} and bit_count(low ^ low2) + bit_count(high ^ high2) <= n + n2 - 2 * {need}"
    pairs = met.where(filters).select("at", "n", "at2", "n2").distinct()
    # The same filter with more bits, for long lines, before the words move. Both sides are named anew, so that their exchanges are the same one.
    side = lambda i, *columns: sets.select(F.col("at").alias(f"at{i}"), *(F.col(c).alias(f"{c}_{i}") for c in columns))
    pairs = pairs.select(F.col("at").alias("at1"), "n", "at2", "n2")
    pairs = pairs.join(side(1, *_WIDE), "at1").join(side(2, *_WIDE), "at2")
    pairs = pairs.where(f"{' + '.join(f'bit_count({c}_1 ^ {c}_2)' for c in _WIDE)} <= n + n2 - 2 * {need}").select("at1", "n", "at2", "n2")
    both = pairs.join(side(1, "words"), "at1").join(side(2, "words"), "at2").withColumnRenamed("at1", "at")
    return both.withColumn("overlap", F.size(F.array_intersect("words_1", "words_2"))).where(_linked(percent)).select("at").distinct()


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, uid, n_lines, n_removed, removed (places of its lines that go, from 0)."""
    source = _source(docs)
    told = _tell(source)
    gone = _removed(source, told, percent).groupBy("uid").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    rows = told.where("n_lines is not null").select("doc_id", "uid", "n_lines")
    out = rows.join(gone, "uid", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.select("doc_id", "uid", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed")


def without_lines(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The documents with their removed lines taken out; other columns stay as they are. The documents are K.fixed ones, as decided upon."""
    row = docs.select(F.struct("*").alias("row"), K.uid(docs).alias("uid")).join(decided.where("n_removed > 0").select("uid", "removed"), "uid", "left")
    kept = F.expr("array_join(filter(split(row.text, '\\n', -1), (x, i) -> not array_contains(removed, i)), '\\n')")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    return row.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
