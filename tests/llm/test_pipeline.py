"""The pipeline stage by stage against brute force."""

import brute
import corpus_pipeline
import test_operators as small
from pyspark.sql import functions as F

from docketry.llm import quality


def test_stages(spark, tmp_path):
    docs = small.documents()
    items = {1: small.PASSAGE}
    folder = str(tmp_path)
    small.frame(spark, docs).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    good = {r.doc_id for r in quality.judge(now).filter("kept").collect()}
    want = {k: t for k, t in docs.items() if k in good}
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == columns
        path = f"{folder}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        steps.append({r.doc_id: r.text for r in now.collect()})
    assert steps[0] == want
    want = {k: x[2] for k, x in brute.lines(want).items()}
    assert steps[1] == want
    near = brute.near(want)
    want = {k: t for k, t in want.items() if near[k][1] == k}
    assert steps[2] == want
    bad = brute.contaminated(want, items)
    want = {k: t for k, t in want.items() if not bad[k][4]}
    assert steps[3] == want
    enc = small.encoder()
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()}
    assert last == {k: len(enc.encode_ordinary(t)) for k, t in want.items()}
    assert now.filter(F.col("n_chars") != F.length("text")).count() == 0


def _tables(spark, folder, rows):
    columns = "doc_id long, text string, lang string, source string, n_chars long, keep string, __gone boolean"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", True) for i, t in rows], columns).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("1", small.PASSAGE)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_repeated_and_missing_ids_and_clashing_columns(spark, tmp_path):
    words = [f"plain{i}" for i in range(200)]
    text = " ".join(words)
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (3, None), (None, None), (4, small.PASSAGE), (None, small.PASSAGE), (5, " ".join(words[::-1]))]
    _tables(spark, tmp_path, rows)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    # both rows of the smallest id stay, and those without one; what the benchmark contaminates goes, with an id or without
    assert sorted(((r.doc_id or 0), r.text) for r in now.collect()) == sorted([(0, text), (0, text), (1, text), (1, text), (5, rows[-1][1])])
    assert {(r.keep, r["__gone"]) for r in now.collect()} == {("k", True)}


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
