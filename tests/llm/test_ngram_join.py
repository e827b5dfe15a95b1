import random
import re

import pytest

from korral.llm.components import components
from korral.llm.ngram_join import ngram_join


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    par = list(range(len(docs)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            x = len(a & b)
            if x and 100 * x >= 75 * (len(a) + len(b) - x):
                par[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low.setdefault(find(i), []).append(d)
    def smallest(i):
        ids = [d for d in low[find(i)] if d is not None]
        return min(ids) if ids else None
    return [(d, len(s), smallest(i)) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def ran(spark, docs):
    df = spark.createDataFrame([(a, b, 1, "q") for a, b in docs], "doc_id long, text string, n int, key string")
    return [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df).collect()]


def test_small(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    docs = [(9, None), (8, ""), (7, " \t"), (6, "One two"), (5, "one TWO"), (4, "one two three four five"), (4, "one two three four five"), (None, "one two"), (30, "ß" * 40000)]
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((100 + i, " ".join(w)))
    passage = " ".join(base[:60])
    docs += [(200 + i, passage + " " + " ".join(f"y{r.randrange(10**6)}" for _ in range(r.randrange(40)))) for i in range(40)]
    # A chain: neighbours link, the ends don't.
    docs += [(300 + i, " ".join(f"c{j}" for j in range(i * 6, i * 6 + 100))) for i in range(12)]
    assert sorted(ran(spark, docs), key=str) == sorted(brute(docs), key=str)


def test_empty(spark):
    assert ran(spark, []) == []


def test_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(ran(spark, docs)) == sorted(brute(docs))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    par = {}
    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            par[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in par}
