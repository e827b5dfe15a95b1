"""Mixing sources to target weights by a minimum-cost flow over membership patterns.

Documents are added up by membership pattern (the set of sources that they
belong to; sources may overlap).  Word capacity flows from the patterns to the
sources' quotas: the first copy of a pattern's words costs nothing, each repeat
costs more than the one before (convex), so no document repeats while unused
ones can still serve the same quota.  The flow of a pattern is then filled with
whole documents in a seeded order: every document for each whole pass, and the
front of the order for the rest, up to the document that comes nearest; then the
one document whose size fits what is missing (or too much) best is added (or
left out), if that comes nearer.

Scale: texts are read once, for their sizes.  The flow is solved on the driver
over one row per pattern; their number is checked (``MAX_PATTERNS``), it doesn't
grow with the documents.  The order is never sorted as a whole: sums over
``2 ** BUCKET_BITS`` ranges of the seeded hash (which combine map-side) find the
range where a pattern's quota ends, and only that range's documents are put in
order, so a source with a third of all rows is no larger a task.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a
source, sorted last; an empty table mixes to nothing; rows that repeat a doc_id
are documents of their own.  Other columns are not read.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from korral.llm import _kernel as K

WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, "mix-1"
MAX_PATTERNS = 50_000
HASH_BITS, BUCKET_BITS = 60, 12


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = REPEATS) -> dict[str | None, float]:
    """Quotas by source: weights repeat over the sources by code point (null last); none is above ``most`` times its size.

    Sources whose cap binds are those with the least cap per weight, so one pass over that order
    settles what capping and resharing again and again would.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total = share * sum(sizes.values()), sum(weight.values())
    out = {}
    for s in sorted(order, key=lambda s: (most * sizes[s] / weight[s], s is None, s or "")):
        if weight[s] * (left / total) < most * sizes[s]:
            break
        out[s] = float(most * sizes[s])
        left -= most * sizes[s]
        total -= weight[s]
    level = left / total if total else 0.0
    return {s: out.get(s, weight[s] * level) for s in order}


def flow(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words sent from each pattern (a tuple of sources) by a minimum-cost maximum flow: successive shortest paths."""
    names = [("p", p) for p in patterns] + [("s", s) for s in quotas]
    at = {n: i + 2 for i, n in enumerate(names)}
    graph: list[list[list]] = [[] for _ in range(len(names) + 2)]

    def arc(a: int, b: int, cap: int, cost: int) -> list:
        there, back = [b, cap, cost, len(graph[b])], [a, 0, -cost, len(graph[a])]
        graph[a].append(there)
        graph[b].append(back)
        return there

    first = {p: [arc(0, at["p", p], size, k) for k in range(repeats)] for p, size in patterns.items()}
    for p, size in patterns.items():
        for s in p:
            arc(at["p", p], at["s", s], repeats * size, 0)
    for s, q in quotas.items():
        arc(at["s", s], 1, q, 0)
    height = [0] * len(graph)
    while True:
        dist, came, heap = {0: 0}, {}, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in graph[a]:
                if e[1] > 0 and (new := d + e[2] + height[a] - height[e[0]]) < dist.get(e[0], float("inf")):
                    dist[e[0]], came[e[0]] = new, (a, e)
                    heapq.heappush(heap, (new, e[0]))
        if 1 not in dist:
            return {p: sum(size - e[1] for e in arcs) for (p, size), arcs in zip(patterns.items(), first.values(), strict=True)}
        for v in range(len(graph)):
            height[v] += dist.get(v, dist[1])
        push, v = float("inf"), 1
        while v:
            v, e = came[v]
            push = min(push, e[1])
        v = 1
        while v:
            v, e = came[v]
            e[1] -= push
            graph[e[0]][e[3]][1] += push


def seeded(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A seeded hash of 60 bits of the id and the text, so rows without an id spread, too; the same in any SQL engine with md5."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    told = F.concat(F.lit(seed + ":"), part(doc_id), F.lit(":"), F.md5(part(text)))
    return F.conv(F.substring(F.md5(told), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, members: Column | None = None, keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """A row per document: doc_id, uid, the ``keep`` columns, members, size, copies, taken, source_size, target.

    ``members`` is an array of the sources a document belongs to (null stands for the null source);
    by default its column ``source`` alone.  source_size and target are those of its first member.
    """
    members = F.array("source") if members is None else members
    rows = docs.select("doc_id", K.uid(docs).alias("uid"), *keep, F.array_sort(F.array_distinct(members)).alias("members"), size_of(F.col("text")).alias("size"), seeded(F.col("doc_id"), F.col("text"), seed).alias("h"))
    rows = K.cut(rows)
    sums = rows.groupBy("members").agg(F.sum("size").alias("size"))
    found = sums.limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: mix by coarser sources")
    patterns = {tuple(r.members): int(r["size"]) for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = targets(sizes, weights, share, repeats)
    sent = flow(patterns, {s: int(t + 0.5) for s, t in quota.items()}, repeats)
    plan = []
    for p, n in patterns.items():
        passes, rest = divmod(sent[p], n) if n else (0, 0)
        plan.append((list(p), sizes[p[0]] if p else 0, quota[p[0]] if p else 0.0, passes, rest))
    kind = rows.schema["members"].dataType.simpleString()
    names = ["members", "source_size", "target", "passes", "rest"]
    types = [to_arrow_type(rows.schema["members"].dataType), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    table = pa.table([pa.array([x[i] for x in plan], t) for i, t in enumerate(types)], names)  # of a list, Spark would start Python workers that stay
    plan_df = F.broadcast(docs.sparkSession.createDataFrame(table, f"members {kind}, source_size bigint, target double, passes bigint, rest bigint"))

    rows = rows.join(plan_df, rows["members"].eqNullSafe(plan_df["members"])).drop(plan_df["members"])
    rows = rows.withColumn("bucket", F.shiftright("h", HASH_BITS - BUCKET_BITS))
    # Where in the seeded order each pattern's rest ends: sums by range of the hash, at most 4096 a pattern.
    buckets = rows.where("rest > 0").groupBy("members", "rest", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(W.partitionBy("members").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    ends = buckets.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest and before + n >= rest")
    ends = F.broadcast(ends.select(F.col("members").alias("m"), F.col("bucket").alias("last"), "before"))  # a row per pattern at most
    rows = rows.join(ends, F.col("members").eqNullSafe(F.col("m")), "left")
    inner = rows.where("bucket = last")
    run = F.sum("size").over(W.partitionBy("members").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    inner = inner.withColumn("run", F.col("before") + F.coalesce(run, F.lit(0))).withColumn("more", F.expr("2 * run + size <= 2 * rest")).drop("run")
    outer = rows.where("last is null or bucket <> last").withColumn("more", F.coalesce(F.expr("bucket < last"), F.lit(False)))
    rows = K.cut(outer.unionByName(inner).drop("m", "last", "before", "bucket"))
    # What is still missing (negative: too much), and the one document that mends it best.
    gap = rows.where("rest > 0").groupBy("members", "rest").agg((F.col("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap")).where("gap <> 0")
    gap = F.broadcast(gap.select(F.col("members").alias("m"), "gap"))
    fit = rows.join(gap, F.col("members").eqNullSafe(F.col("m"))).where("more = (gap < 0) and abs(size - abs(gap)) < abs(gap)")
    flip = fit.groupBy("m").agg(F.min(F.struct(F.expr("abs(size - abs(gap))").alias("off"), "h", "doc_id", "uid")).alias("b"))
    flip = F.broadcast(flip.select(F.col("b.uid").alias("flip")))
    copies = F.col("passes") + (F.col("more") != F.col("flip").isNotNull()).cast("bigint")
    out = rows.join(flip, F.col("uid") == F.col("flip"), "left").withColumn("copies", copies)
    return out.select("doc_id", "uid", *keep, "members", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source_size", "target")
