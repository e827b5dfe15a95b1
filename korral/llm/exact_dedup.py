"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without its white space is cut into chunks whose ends depend on the
content alone (the end of a sentence, past a least size).  A chunk's handle is a
64-bit hash; the dictionary of distinct (handle, SHA-256) verifies it: a handle
that stands for several chunks is split by an ordinal, so an identifier
(handle, ordinal) means one chunk.  A document is then its recipe, the ordered
list of its identifiers, and documents are equal when their recipes are.

Texts are read once and never move: what is shuffled is 40 bytes per distinct
chunk and 8 bytes per chunk of each recipe.  Both groupings combine map-side, so
a group of copies costs a row per map task; the way back from a group to its
rows is a join with one row per group on one side, whose skew AQE splits.

Edge cases: null counts as empty, and all empty or blank texts are one group.
Of equal texts the one with the most code points in its original stays, then
the smallest doc_id (null last); of rows that repeat a doc_id with equal text
one stays.  Each input row gives one row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korral.llm import _kernel as K

SPACE = r"[\x20\x09-\x0D]"
#: Least and largest code points of a chunk.
LEAST, MOST = 512, 8192


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    return rf"(?s).{{{least},{most}}}?(?:[.!?;。！？]|\z)|.{{1,{most}}}"


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST, handle_bits: int = 64) -> DataFrame:
    """A row per document: doc_id, uid, chars, text_sha256, and its chunks as handles and digests."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", K.uid(docs).alias("uid"), F.char_length(text).cast("bigint").alias("chars"), F.regexp_replace(text, SPACE + "+", "").alias("norm"))
    rows = rows.withColumn("chunks", F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)))
    handle = F.expr(f"transform(chunks, c -> shiftrightunsigned(xxhash64(c), {64 - handle_bits}))")
    return rows.select("doc_id", "uid", "chars", F.sha2("norm", 256).alias("text_sha256"), handle.alias("handles"), F.expr("transform(chunks, c -> unhex(sha2(c, 256)))").alias("digests"))


def identified(rows: DataFrame) -> DataFrame:
    """Recipes with verified identifiers: ``ords`` is null unless a handle of the row stands for several chunks."""
    chunks = rows.select(F.explode(F.arrays_zip("handles", "digests")).alias("c")).select("c.handles", "c.digests").toDF("handle", "digest")
    split = chunks.groupBy("handle").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("handle")
    split = K.cut(split)
    if split.isEmpty():
        return rows.drop("digests").withColumn("ords", F.lit(None).cast("array<bigint>"))
    # Only chunks under a split handle are numbered; only their rows are put together again.
    number = chunks.join(split, "handle").distinct()
    number = number.alias("a").join(number.alias("b"), F.expr("a.handle = b.handle and b.digest < a.digest"), "left").groupBy("a.handle", "a.digest").agg(F.count("b.digest").alias("ord"))
    each = rows.select("uid", F.posexplode(F.arrays_zip("handles", "digests")).alias("pos", "c")).select("uid", "pos", F.col("c.handles").alias("handle"), F.col("c.digests").alias("digest"))
    own = each.join(number, ["handle", "digest"]).where("ord > 0").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "ord"))).alias("o"))
    ords = F.expr("flatten(transform(o, x -> array(cast(x.pos as bigint), x.ord)))")
    return rows.drop("digests").join(own.select("uid", ords.alias("ords")), "uid", "left")


def exact_dedup(docs: DataFrame, least: int = LEAST, most: int = MOST, handle_bits: int = 64) -> DataFrame:
    """A row per document: doc_id, uid, keep_id, keep_uid, group_size, kept, text_sha256, n_chunks."""
    rows = K.cut(recipes(docs, least, most, handle_bits))
    rows = identified(rows).withColumn("ords", F.coalesce("ords", F.array().cast("array<bigint>")))
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    groups = rows.groupBy("handles", "ords").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("handles", "ords", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid"))
    out = rows.join(groups, ["handles", "ords"])
    return out.select("doc_id", "uid", "keep_id", "keep_uid", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256", F.size("handles").alias("n_chunks"))
