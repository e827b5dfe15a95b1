"""Trained operators: small cases, and held-out accuracy on the tables."""

import pytest
from pyspark.sql import functions as F

from korral.llm import html_extract as H
from korral.llm import language_id, quality, toxicity
from korral.llm.learning import held_out
from korral.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, score double, uid string"
ODD = [(None, "Some text.", "en"), (5, None, "de"), (6, "", "de"), (7, " \n", None), (8, "1 2 3 !!!", "fr"), (9, "é" * 60000, "fr"), (9, "é" * 60000, "fr"), (10, "word " * 30000, "en")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "k") for r in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_is_crc32(spark):
    import zlib

    df = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", held_out("doc_id", 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df)
    assert frame(spark, ODD).where("doc_id is null").select(held_out("doc_id", 4, 2)).first()[0] is False


def test_toxicity_finds_the_sentence(spark):
    docs = [(i, "A quiet day. " * (1 + i % 5) + ("You vile slug. " if i % 3 == 0 else "") + f"Rain number {i} fell.", "en") for i in range(300)]
    df = frame(spark, docs + ODD)
    model = toxicity.train(df, labels(spark, [(i, None, int(i % 3 == 0)) for i in range(300)] + [(5, None, None)]))
    got = {(r.doc_id, r.uid): r for r in toxicity.score_toxicity(df, model).collect()}
    assert len(got) == len(docs) + len(ODD)
    for (d, _), r in got.items():
        assert 0 <= r.score <= 1
        if d is not None and d > 20 and d < 300:
            assert (r.score >= 0.5) == (d % 3 == 0)
            assert all("vile" in s.text for s in r.offending) and bool(r.offending) == (d % 3 == 0)
    assert sum(r.score == 0 and r.n_sentences == 0 for r in got.values()) == 3


def test_toxicity_ranks_on_the_executors_as_in_the_fit(spark, sf):
    """The sample isn't cut, and what reaches the driver gives the model that all features give."""
    assert (toxicity.POSITIVES, toxicity.NEGATIVES) == (1500, 3000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    rows = docs.join(known, "doc_id").select("y", "text").orderBy("doc_id").coalesce(1).mapInArrow(toxicity._sample, "y int, sizes array<int>, features array<bigint>")
    for features in (6000, 40):
        models = []
        keys = toxicity._ranked(rows, features)
        for got in (rows.toArrow().combine_chunks(), toxicity._only(rows, keys).toArrow().combine_chunks()):
            y = got.column("y").to_numpy().astype(bool)
            models.append(toxicity.fit(y, got.column("sizes").combine_chunks(), got.column("features").combine_chunks(), {0: int((~y).sum()), 1: int(y.sum())}, features))
        assert 0 < len(keys) <= features and (models[0].keys == models[1].keys).all() and abs(models[0].weights - models[1].weights).max() < 1e-9


def test_toxicity_without_labels(spark):
    df = frame(spark, ODD)
    for rows in ([], [(5, 1, 0)], [(5, 1, None)]):
        assert all(r.score < 0.01 for r in toxicity.score_toxicity(df, toxicity.train(df, labels(spark, rows))).collect())
    assert toxicity.score_toxicity(df.limit(0), toxicity.train(df, labels(spark, []))).count() == 0


def test_quality_learns_without_negatives(spark):
    docs = [(i, ("SHOUT!! " * 40 if i % 4 == 0 else f"A calm sentence number {i} goes on, and ends here. " * (3 + i % 4)), "en") for i in range(400)]
    df = frame(spark, docs + ODD)
    model = quality.train(df, labels(spark, [(i, int(i % 4 != 0), 0) for i in range(0, 400)]))
    got = quality.score_quality(df, model).collect()
    assert len(got) == len(docs) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.doc_id is not None and r.doc_id > 20]
    assert all((r.score >= 0.7) == (r.doc_id % 4 != 0) for r in own)


def test_quality_without_labels(spark):
    df = frame(spark, ODD)
    assert all(r.score == pytest.approx(0.5) for r in quality.score_quality(df, quality.train(df, labels(spark, []))).collect())


def test_language_backs_off(spark):
    docs = [(i, "der hund schläft nicht" if i % 2 else "the dog sleeps quietly", "de" if i % 2 else "en") for i in range(80)]
    df = frame(spark, docs + ODD)
    model = language_id.train(df)
    new = frame(spark, [(1, "hundschläft", None), (2, "quietlydog", None), (3, "123", None), (4, None, None), (5, "SCHLÄFT", "en")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(new, model).collect()}
    assert got[1][0] == "de" and got[2][0] == "en" and got[5][0] == "de" and got[3] == got[4] == ("und", 0.0)
    odd = language_id.identify(df, model).collect()
    assert len(odd) == len(docs) + len(ODD) and all(0 <= r.score <= 1 for r in odd)
    nothing = language_id.train(df.where("lang is null"))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


@pytest.mark.parametrize("name,label,floor", [("op3_quality_classifier", "quality", 0.85), ("op9_toxicity", "toxic", 0.75)])
def test_held_out_accuracy(spark, name, label, floor):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(F.col(label).isNotNull())
    assert got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= floor


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_language_id"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.98


PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>x</p>";</script></head><body>
<nav class="menu"><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav>
<div id="cookie-consent"><p>We use cookies here.</p><button>Fine</button></div>
<article><h1>Big &amp; small</h1><p>First para &lt;one&gt; with <b>bold<br>line</b> and more words in it.<p>Second  para,
 with a <a href=/x>link</a> in the middle of it.<ul><li>an item<li>another item</ul><!-- gone --></article>
<section class="comments"><h3>Comments</h3><div><p>Nice read, thanks.</p></div></section>
<aside><p>Related things.</p></aside><form><label>Name</label><input></form><footer>&copy; 2020 x</footer></body></html>"""


def test_page():
    want = "Big & small\nFirst para <one> with bold line and more words in it.\nSecond para, with a link in the middle of it.\nan item\nanother item"
    assert H.main_text(PAGE, H.default_model()) == want


def test_self_closed_raw_elements():
    """A raw element opens nothing, so its slash closes nothing: at the start of a page, and inside an article."""
    for raw in ('<script src="a.js"/></script>', '<iframe src="x"/></iframe>', "<script src=https://a.org/></script>", "<svg><title/></svg>"):
        assert [b.text for b in H.parse(f"{raw}<p>One.</p>")] == ["One."]
        inside = H.parse(f"<article><p>One.</p>{raw}<p>Two.</p></article>")
        assert [b.text for b in inside] == ["One.", "Two."] and inside[0].features == inside[1].features and "tag=article" in inside[1].features
    assert H.parse('<script src="a.js"/>') == []


def test_crf_on_unseen_pages():
    pages = [p for p in H.labelled_pages(150, seed=1234) if p]
    model = H.default_model()
    hits = [got == b.label for p in pages for got, b in zip(model.decode(p), p)]
    assert sum(hits) / len(hits) > 0.99


def test_viterbi_is_the_best_path():
    import itertools

    model = H.default_model()
    page = [p for p in H.labelled_pages(40, seed=5) if 2 <= len(p) <= 10][0]

    def score(path):
        total = model.start[path[0]]
        for i, (b, s) in enumerate(zip(page, path)):
            total += sum(model.emit.get(f, (0, 0))[s] for f in b.features) + (model.step[path[i - 1]][s] if i else 0)
        return total

    best = max(itertools.product((0, 1), repeat=len(page)), key=score)
    assert [bool(x) for x in best] == model.decode(page)


def test_odd_pages(spark):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "<p>"), (3, "u", "no markup at all"), (4, "u", "<<<>>> </div></p> <p"), (5, "u", "<script>never closed"), (None, "u", "<article><p>" + "long words here " * 40000 + "</p></article>"), (6, "u", PAGE)]
    got = H.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r for r in got if r.page_id is None][0].n_chars == 40000 * 16 - 1
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tables_against_their_layout(spark, sf):
    """The article of these pages is what stands in <article>, a block per heading or paragraph."""
    import html
    import re

    for r in QUERIES["op5_html_extraction"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


WORST = {"unclosed tags": "<a " * 350_000, "open blocks": "<div>x" * 60_000, "open inline": "<b class=x>" * 80_000 + "</i>" * 80_000, "stray quote": "<x " * 300_000 + '">', "open quotes": '<a href="' * 100_000,
         "closings across a block": "<i><div>" + "<b id=q>y" * 50_000 + "</i>" * 100_000, "attribute": "<a " + "b" * 500_000 + "=>", "comments": "<!--" * 200_000, "less than": "< " * 300_000}


@pytest.mark.parametrize("name", WORST)
def test_malformed_pages_take_linear_time(name):
    import time

    began = time.process_time()
    H.main_text(WORST[name], H.default_model())
    assert time.process_time() - began < 15


def test_stray_quotes_and_attributes():
    blocks = H.parse("<p class='main' title=\"a > b\" data-x=1>one</p><p \">two</p><p class=>three</p><p x = 'y>z'>four")
    assert [b.text for b in blocks] == ["one", "two", "three", "four"] and "hint=main" in blocks[0].features and "hint=main" not in blocks[1].features


def test_prior_is_estimated_from_positives_and_unlabelled():
    import numpy as np

    r = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        pos = r.normal(2, 1, (3000, quality.FEATURES))
        good = r.random(6000) < share
        unl = np.where(good[:, None], r.normal(2, 1, (6000, quality.FEATURES)), r.normal(-2, 1, (6000, quality.FEATURES)))
        assert abs(quality.estimate_prior(pos, unl) - good.mean()) < 0.05


def test_quality_score_by_hand(spark):
    """The vectorised features and score against one character at a time."""
    import math

    import numpy as np

    r = np.random.default_rng(1)
    model = quality.Model(r.normal(size=quality.FEATURES), 1 + r.random(quality.FEATURES), r.normal(size=quality.FEATURES) / 20, 0.3)
    texts = ["", "One two two three.\nOne two two three.\n", "A!!", "é à 12, x", "a b c a b c d\r\n\r\nq", " \t ", "long " * 500]

    def brute(t):
        raw, f = t.encode(), [0.0] * quality.FEATURES
        for a, b in zip(raw, raw[1:]):
            f[int(quality.CLASS[a]) * quality.CLASSES + int(quality.CLASS[b])] += 1
        for i in range(quality.CLASSES**2):
            f[i] = math.sqrt(f[i] / max(len(raw) - 1, 1))
        w = t.split() if "\r" not in t else [x for x in t.replace("\r", " ").split()]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        lines = [x for x in t.replace("\r", "\n").split("\n") if x]
        top = lambda x: max((x.count(y) for y in set(x)), default=0)
        n, m = max(len(w), 1), max(len(tri), 1)
        f[quality.CLASSES**2 :] = [math.log1p(len(raw)), math.log1p(len(w)), sum(len(x.encode()) for x in w) / n, 1 - len(set(w)) / n, top(w) / n, 1 - len(set(tri)) / m, top(tri) / m, sum(a == b for a, b in zip(w, w[1:])) / n, 1 - len(set(lines)) / max(len(lines), 1), len(lines) / n]
        return 1 / (1 + math.exp(-(sum(min(8, max(-8, (x - mu) / s)) * c for x, mu, s, c in zip(f, model.mean, model.scale, model.weights)) + model.bias)))

    got = quality.score_quality(frame(spark, [(i, t, "x") for i, t in enumerate(texts)]), model).collect()
    assert [r.score for r in sorted(got, key=lambda r: r.doc_id)] == pytest.approx([brute(t) for t in texts], abs=1e-5)


def test_toxicity_score_by_hand(spark):
    """The noisy-or of the sentences and their places, from a model of two words and a front."""
    import math
    import re

    import numpy as np

    from korral.llm import _kernel as K

    def key(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(K.value_hash(K.BYTE_VALUE[K.LOWER][raw], np.array([0]), np.array([len(raw)]))[0][0])

    def front(word, k):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(K.value_hash(K.BYTE_VALUE[K.LOWER][raw], np.array([0]), np.array([len(raw)]), (k,))[1][0][0])

    known = sorted([(key("vile"), 5.0), (key("day"), -1.0), (front("slugger", 5), 2.5)])
    keys = np.array([k for k, _ in known], np.uint64)
    bits = np.full(1 << 19, 255, np.uint8)
    model = toxicity.Model(keys, np.array([w for _, w in known]), -3.0, bits)
    texts = ["A Vile day. Été, vile vile SLUGGERS! Fine", "", "...", "day", "slug vile\nsluggish x? é vile", None]

    def brute(t):
        clean, places = 1.0, []
        for m in re.finditer(r"[^.!?\n]+", t or ""):
            words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", m[0]))
            if words:
                low = [w[0].lower() for w in words]
                z = -3 + sum(5.0 * (w == "vile") - 1.0 * (w == "day") + 2.5 * (w.startswith("slugg") and len(w) > 5) for w in low)
                clean *= 1 - 1 / (1 + math.exp(-z))
                if z >= 0:
                    places.append((m.start() + words[0].start(), m.start() + words[-1].end()))
        return 1 - clean, places

    got = sorted(toxicity.score_toxicity(frame(spark, [(i, t, "x") for i, t in enumerate(texts)]), model).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts):
        score, places = brute(t)
        assert r.score == pytest.approx(score) and [(o.start, o.end) for o in r.offending] == places and all(o.text == t[o.start : o.end] for o in r.offending)


def test_language_score_by_hand(spark):
    """Word-first backoff, one word at a time, with the model's own tables."""
    import math

    import numpy as np

    docs = [(i, "der hund schläft nicht im haus" if i % 2 else "the dog sleeps quietly in a house", "de" if i % 2 else "en") for i in range(80)]
    model = language_id.train(frame(spark, docs))

    def table(k, text):
        cp, at = language_id._points(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        s, e, _, h = language_id._words(cp, at)
        keys, values = model.tables[k]
        look = h if k == 0 else language_id._grams(cp, s, e, k)[1]
        return [values[i] for x in look if (i := int(np.searchsorted(keys, x))) < len(keys) and keys[i] == x]

    texts = ["Der dog", "hundehaus", "quietlyhund x", "zzz", "schläfst housing 12 in"]
    got = sorted(language_id.identify(frame(spark, [(i, t, None) for i, t in enumerate(texts)]), model).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts):
        z = np.zeros(2)
        for w in t.split():
            for k in (0, 5, 4, 3, 2, 1):
                found = table(k, w)
                if found:
                    z += np.mean(found, 0)
                    break
        best = int(z.argmax())
        assert r.lang_pred == model.langs[best] and r.score == pytest.approx(1 / sum(math.exp(x - z[best]) for x in z))


def test_samples_are_bounded(spark):
    """An id that repeats gives one text, long texts aren't trained on, and few ids are drawn from many without sorting all."""
    from korral.llm import learning as L

    docs = frame(spark, [(1, f"text {i}", "en") for i in range(50)] + [(2, "x" * (L.TRAIN_BYTES + 1), "en"), (3, None, "en")])
    got = {r.doc_id: r.text for r in L.with_texts(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, y int")).collect()}
    assert got == {1: "text 0", 3: None}
    ids = spark.range(5000).withColumnRenamed("id", "doc_id").union(spark.range(20).selectExpr("id as doc_id"))
    want = [r.doc_id for r in ids.distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(30).collect()]
    assert sorted(r.doc_id for r in L.first_ids(ids, 30).collect()) == sorted(want)
    assert L.first_ids(ids.where("doc_id < 3"), 30).count() == 3 and L.first_ids(spark.range(5000).selectExpr("1L as doc_id"), 30).count() == 1
