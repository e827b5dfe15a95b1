import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from korral.llm.mixing import flow, mix, targets
from korral.llm.oracle import ORACLES
from korral.llm.queries import QUERIES


def test_targets_by_resharing():
    sizes = {"a": 10, "b": 1000, "c": 500, None: 7, "B": 0}
    order, got = ["B", "a", "b", "c", None], targets(sizes)
    weight = dict(zip(order, (3, 1, 2, 3, 1)))
    free, want, left = set(order), {}, 1.5 * sum(sizes.values())
    while True:  # cap and reshare until nothing is above its cap
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        free -= over
    want |= share
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_flow_is_cheapest():
    patterns, quotas = {("a",): 3, ("a", "b"): 2, ("b",): 1}, {"a": 6, "b": 4}
    sent = flow(patterns, quotas)
    cost = lambda f: sum(max(0, f[p] - n) for p, n in patterns.items())
    best = None
    for fa, fb, x, y in itertools.product(range(7), range(3), range(5), range(5)):
        if x + y <= 4 and fa + x <= 6 and fb + y <= 4:
            f = {("a",): fa, ("a", "b"): x + y, ("b",): fb}
            best = max(best or (0, 0), (sum(f.values()), -cost(f)))
    assert (sum(sent.values()), -cost(sent)) == best


def test_small(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "one two", None), (4, "one two", None), (None, "q " * 50, "y"), (6, "z", "y"), (7, "long " * 5000, "x")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size string, taken int")
    out = mix(df).drop("uid").collect()
    assert len(out) == len(rows) and all(r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in out)
    assert sorted(map(str, mix(df.repartition(5)).drop("uid").collect())) == sorted(map(str, out))
    assert mix(df.limit(0)).count() == 0


def test_overlapping_sources(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 17 + 1 as int))").alias("text"), F.expr("case when id % 5 = 0 then array('a', 'b') when id % 2 = 0 then array('a') else array('b') end").alias("m"))
    out = mix(df, members=F.col("m")).collect()
    total = sum(r["size"] * len(r.members) for r in out)
    assert abs(sum(r.taken for r in out) - 1.5 * total) <= 4 and all(r.copies <= 2 for r in out)


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ORACLES["op6_source_mixing"]).fetchall()
    got = [tuple(r) for r in QUERIES["op6_source_mixing"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
