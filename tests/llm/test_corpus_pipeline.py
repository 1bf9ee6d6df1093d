"""The pipeline's stages against brute-force versions on a small table, and its awkward cases."""

from __future__ import annotations

import corpus_pipeline
from samples import empty, frame
from test_exact import brute_components

from hazeline.llm.common import written


def test_stages_in_turn(spark, docs, rows, tmp_path):
    spark.createDataFrame([(1, " ".join(rows[75][1].split()[:12]))], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    kinds = dict(docs.dtypes)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert dict(docs.dtypes) == kinds
        if name == "jaccard_join":
            own = [(r.doc_id, r.text) for r in before.collect()]
            heads = {c for i, n, c in brute_components(own) if n} | {i for i, n, _ in brute_components(own) if not n}
            assert {r.doc_id for r in docs.collect()} == heads
        if name == "decontamination":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert gone <= {75} and before.count() - docs.count() == len(gone)
        if name == "secret_scan":
            assert docs.count() == before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count() and last.where("n_tokens <> size(ids)").count() == 0


def test_rows_that_repeat_are_one_document(spark):
    rows = [(5, "ba do ki lu me no pa"), (5, "ba do ki lu me no pa"), (6, "ri su ti vo ba do ki"), (7, None), (None, "ti vo su")]
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id for r in got), key=repr) == [5, 6, 7, None]


def test_texts_under_one_doc_id_are_documents_of_their_own(spark):
    """Unrelated texts that share a doc_id both stay; a near copy of a smaller doc_id goes, whatever else bears its doc_id."""
    base = "ba do ki lu me no pa ri su ti vo ba ri do su ki ti lu vo me ba ba do do ki ki lu lu me me no no pa pa ri ri su su ti ti"
    rows = [(5, base), (5, "kein wort davon steht dort in dem text"), (9, base + " vo"), (9, "ein ganz anderer text unter neun hier"), (3, base + " ba")]
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text[:4]) for r in got) == [(3, "ba d"), (5, "kein"), (9, "ein ")]


def test_nothing_in_nothing_out(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
