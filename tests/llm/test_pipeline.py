import json
import os
import subprocess
import sys

import corpus_pipeline
from korral.llm import stages
from korral.llm.line_dedup import line_dedup

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make(spark, path):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, text, "a"), (2, text.replace(" ", "  "), "a"), (2, text.replace(" ", "  "), "a"), (3, " ".join(f"w{i}" for i in range(60)), "b"), (4, " ".join(f"w{i}" for i in range(59)), "b"), (5, " ".join(f"q{i}" for i in range(13)) + " tail", None), (6, None, "b"), (7, "", "a"), (None, "lone words stand here", "c")]
    df = spark.createDataFrame([(*r[:2], "en", r[2], 9, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, uid string")
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(13)))], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_take_effect(spark, tmp_path):
    docs = make(spark, str(tmp_path))
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    a = stages.drop_toxic(spark, docs, str(tmp_path))
    assert a.columns == docs.columns and a.count() == 9
    b = stages.drop_copies(spark, docs, str(tmp_path))
    assert ids(b) == ["2", "3", "4", "5", "6", "None"] and b.columns == docs.columns  # 6 and 7 are equal
    c = stages.drop_near_copies(spark, docs, str(tmp_path))
    assert ids(c) == ["1", "3", "5", "6", "7", "None"] and c.columns == docs.columns
    assert ids(stages.drop_contaminated(spark, docs, str(tmp_path))) == ["1", "2", "2", "3", "4", "6", "7", "None"]
    m = stages.mix_sources(spark, docs, str(tmp_path)).collect()
    assert all(0 < r.copies <= 2 and r.taken == r.copies * r["size"] for r in m)


def test_near_copies_are_grouped_by_component(spark, tmp_path):
    """Null ids, and one id on different texts, are components of their own."""
    words = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcde"}
    rows = [(None, words["a"]), (None, words["b"]), (None, words["b"].upper()), (5, words["c"]), (5, words["d"]), (5, words["d"] + " more"), (7, words["e"] + " more"), (None, words["e"]), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    left = stages.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect()
    assert sorted(str(r.text)[:1] for r in left if r.text is None or r.text[0] not in "Bb") == ["N", "a", "c", "d", "e"]
    assert len(left) == 6 and [r.doc_id for r in left if str(r.text)[0] == "e"] == [7]


def test_other_splits_of_a_scan_drop_the_same_rows(spark, tmp_path):
    """Between two scans of the same files the number of cores may change, and with it how files are dealt to tasks."""
    make(spark, str(tmp_path)).repartition(5).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    # The same, of documents that Parquet doesn't number.
    docs.where("doc_id > 0 or doc_id is null").write.json(f"{tmp_path}/j")
    lines = lambda df: sorted((str(r.doc_id), r.n_lines, r.removed) for r in df.collect())
    right = {"drop_copies": [2, 3, 4, 5, 6, None], "drop_near_copies": [1, 3, 5, 6, 7, None], "drop_contaminated": [1, 2, 2, 3, 4, 6, 7, None]}
    try:
        for source in (docs, spark.read.schema(docs.schema).json(f"{tmp_path}/j")):
            for name, ids in right.items():
                spark.conf.set("spark.sql.files.minPartitionNum", 1)
                left = getattr(stages, name)(spark, source, str(tmp_path))
                spark.conf.set("spark.sql.files.minPartitionNum", 64)
                assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, ids)), name
            same = lines(line_dedup(source))
            spark.conf.set("spark.sql.files.minPartitionNum", 1)
            out = line_dedup(source)
            spark.conf.set("spark.sql.files.minPartitionNum", 64)
            assert lines(out) == same
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_run(spark, tmp_path):
    make(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect() if r["size"]} <= {2, 3, None} and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
    # By hand: each stage written and read again.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    assert sorted(map(str, docs.collect())) == sorted(map(str, out.collect()))


def test_empty(spark, tmp_path):
    make(spark, str(tmp_path))
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_the_rest_stands_without_this_package(tmp_path):
    """Without the subpackage and the pipeline the entry still imports, and has the other queries."""
    code = "import sys; sys.modules['korral.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    names = json.loads(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout)
    assert "shapley" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
