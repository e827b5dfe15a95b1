import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from korral.llm import line_dedup as L
from korral.llm.line_dedup import line_dedup, without_lines


def words(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def brute(docs):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    earlier, gone = [], {}
    for i in order:
        text = docs[i][1]
        for j, line in enumerate(text.split("\n") if text else []):
            s = words(line)
            if s:
                if any(100 * len(s & e) >= 75 * len(s | e) for e in earlier):
                    gone.setdefault(i, []).append(j)
                earlier.append(s)
    return [(d, len(t.split("\n")) if t else 0, gone.get(i, [])) for i, (d, t) in enumerate(docs)]


def check(spark, docs):
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, uid int, removed string").coalesce(1)
    out = line_dedup(df)
    got = sorted(((r.doc_id, r.n_lines, r.removed) for r in out.collect()), key=str)
    want = brute(docs)
    assert got == sorted(want, key=str)
    texts = sorted(((r.doc_id, r.text) for r in without_lines(df, out).collect()), key=str)
    assert texts == sorted(((d, t if not g else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in g)) for (d, t), (_, _, g) in zip(docs, want)), key=str)


def test_small(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    docs = [(5, None), (6, ""), (7, "\n\n"), (8, "a b c\nA  b c\nd\n"), (9, "a b c"), (None, "d\nlast words here"), (3, "x"), (3, "x"), (20, "é" * 30000 + "\n" + "é" * 30000)]
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        docs.append((100 + i, "\n".join((" ".join(w), f"only {i} here and nowhere else today", " ".join(w[:30])))))
    check(spark, docs)


def test_empty(spark):
    check(spark, [])


def test_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, docs[:120])


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, *(getattr(store, f"stageList$default${i}")() for i in range(2, 6)))
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_few_lines_shuffle_few_rows(spark):
    """The words' counts travel as arrays, not as a row for each slot and task."""
    df = spark.createDataFrame([(i, f"some words of line {i} stand here\nand others there") for i in range(20)], "doc_id long, text string").repartition(3)
    before = shuffled(spark)
    assert sum(r.n_removed for r in line_dedup(df).collect()) == 38
    assert 0 < shuffled(spark) - before < 1 << L.SLOTS


def test_shared_tokens_lose_no_partner(monkeypatch):
    """Few slots and tokens, so that words of one line share them: every record that matches another one still has an entry left."""
    monkeypatch.setattr(L, "SLOTS", 2)
    monkeypatch.setattr(L, "TOKEN_BITS", 6)
    r = random.Random(5)
    lines = []
    for i in range(60):
        w = [f"w{r.randrange(400)}" for _ in range(r.randrange(3, 60))]
        lines.append(" ".join(w))
        w[r.randrange(len(w))] = f"x{i}"
        lines.append(" ".join(w[r.randrange(2) :]))
    text = "\n".join(lines)
    counts = SimpleNamespace(value=np.array([5, 1, 9, 3]))
    batch = pa.record_batch({"text": [text, text]})
    dealt = pa.Table.from_batches(list(L._deal(iter([batch, batch]), 3, counts, 75)))
    left = {i for b in range(3) for i in L._partners(dealt.filter(pc.equal(dealt["block"], b)), 75)["id"].to_pylist()}
    data = np.frombuffer(text.encode(), np.uint8)
    _, _, _, _, keys = L._sets(data, L._cut_lines(data, np.array([0, len(data)]))[0])
    sets = [words(x) for x in lines]
    want = {k for k, a in zip(keys[:, 0].view(np.int64).tolist(), sets) if any(a != b and 100 * len(a & b) >= 75 * len(a | b) for b in sets)}
    assert len(want) > 40 and want <= left


def test_order_where_one_value_leaves_words_apart():
    own = np.array([0, 0, 0, 1, 1], np.int64)
    h = np.array([7, 5, 7, 1 << 60, 3], np.uint64)
    assert L._in_lines(own, h, 3).tolist() == [5, 7, 7, 3, 1 << 60]
    rarity = np.arange(1 << L.SLOTS, dtype=np.uint64)[::-1] << np.uint64(L.TOKEN_BITS - L.SLOTS)
    assert (L._tokens(own, h, 2, rarity) == L._tokens(own, h, 1 << 20, rarity)).all()
