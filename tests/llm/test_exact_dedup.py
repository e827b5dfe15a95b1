import hashlib
import re
from collections import defaultdict

import duckdb

from korral.llm.exact_dedup import exact_dedup
from korral.llm.oracle import ORACLES
from korral.llm.queries import QUERIES


def brute(docs):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, i))
    out = []
    for norm, g in groups.items():
        g.sort()
        for c, none, d, i in g:
            out.append((docs[i][0], docs[g[0][3]][0], len(g), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


DOCS = [(5, "a b c"), (2, "abc"), (3, "ab  c"), (4, None), (1, ""), (9, "\t\n"), (7, "x y"), (8, "xy"), (6, "Long one. " * 3000), (10, "Long one. " * 3000 + "x"), (11, "Longone. " * 3000),
        (12, "q" * 30000), (13, "q" * 30000), (13, "q" * 30000), (None, "abc "), (None, "zz"), (14, "🙂." * 700), (15, "🙂. " * 700)]


def check(spark, **kw):
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in DOCS], "doc_id long, text string, kept int, uid string").repartition(3)
    got = exact_dedup(df, **kw).collect()
    want, groups = brute(DOCS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups


def test_small(spark):
    check(spark)


def test_colliding_handles_are_split(spark):
    check(spark, least=2, most=7, handle_bits=3)


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ORACLES["op1_exact_dedup"]).fetchall()
    got = [tuple(r) for r in QUERIES["op1_exact_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(want)
