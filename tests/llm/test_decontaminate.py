import re
from collections import defaultdict

import pytest

from korral.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            m = min(window, len(w))
            for a in range(len(w) - m + 1):
                wins[tuple(w[a : a + m])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for m in {len(k) for k in wins}:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in wins:
                    ids |= wins[tuple(w[a : a + m])]
                    hit |= set(range(a, a + m))
        out.append((d, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def ran(spark, docs, items):
    d = spark.createDataFrame([(a, b, 7, "x") for a, b in docs], "doc_id long, text string, uid int, n_words string")
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, size int")
    return [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate(d, i).collect()]


def key(r):
    return str(r)


def test_small_cases(spark):
    body = " ".join(f"w{i}" for i in range(40))
    items = [(1, body), (2, "one two"), (3, None), (4, "..."), (5, body), (5, body), (6, " ".join(f"W{i}," for i in range(10, 23)))]
    docs = [(1, body), (2, "x " + " ".join(f"w{i}" for i in range(5, 20)) + " y" * 100), (3, None), (4, ""), (5, "ONE two three one two"), (5, "ONE two three one two"),
            (None, body), (6, " ".join(f"w{i}" for i in range(12))), (7, "z " * 20000 + body), (8, body + " " + body), (9, "é" * 50000)]
    assert sorted(ran(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)


@pytest.mark.parametrize("docs,items", [([], [(1, "a b")]), ([(1, "a b c")], [])])
def test_empty(spark, docs, items):
    assert ran(spark, docs, items) == brute(docs, items)


def test_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(ran(spark, docs, items), key=key)
    assert got == sorted(brute(docs, items), key=key) and any(r[4] for r in got)
