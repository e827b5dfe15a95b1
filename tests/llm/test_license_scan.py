import re

from korral.llm.license_scan import BASE, TEMPLATES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label, n < BASE) for n, (_, phrase, label) in enumerate(TEMPLATES) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    mine = [p for p in places if p[2]]
    return (len(w), len(mine), min((p[0] for p in mine), default=None), max((p[0] for p in mine), default=None), ",".join(sorted({p[1] for p in mine})), ",".join(sorted({p[1] for p in places})))


def check(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_words int, labels string")
    got = scan_licenses(df).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in texts), key=key)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def test_small(spark):
    texts = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, "Apache License, Version 2.0 under-the-MIT-license; CC BY-NC cc by nc"), (5, "the mit license"), (6, "under the mit license" * 3), (7, "under the mit license " * 50),
             (8, "été under the ÉMIT license"), (8, "K under the MIT license cc\nby\tnc"), (None, "GNU General Public License, version 3"), (9, "x " * 50000 + "cc-by-nc"), (10, "cc0 by nc cc by"), (11, "...")]
    check(spark, texts)
    check(spark, [])


def test_tables(spark, sf):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_long_notices(spark):
    apache = "You may not use this file except in compliance with the License; you may obtain a copy"
    texts = [(1, apache), (2, apache.replace("file", "files")), (3, "x " + apache + "\n" + apache.upper()), (4, "K " + apache.replace("License", "LICENSE"))]
    check(spark, texts)
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1].labels == "apache-2" and got[1].n_base == 0 and got[2].labels == "" and len(got[3].places) == 2 and got[4].n_words == 18


def test_oracle(spark, sf):
    import duckdb

    from korral.llm import oracle, queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(oracle.ORACLES["op7_license_scan"]).fetchall()
    columns = [d[0] for d in con.description]
    got = queries.op7(spark, sf).select(*columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
