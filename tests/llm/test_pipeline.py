"""The pipeline's stages and registered queries on the small tables."""

from __future__ import annotations

import importlib.util
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import language_id, line_crf
from tapeloom.llm.common import bounded_batches, read

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def test_entry_has_the_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert importlib.util.find_spec("tapeloom.llm")


def test_stages(spark):
    """Rules and language keep what their operators accept, one document of each group stays, and the rest is packed whole."""
    from test_llm_operators import brute_links, brute_repeats

    bounded_batches(spark)
    docs = read(spark, SF, "documents")
    columns = docs.columns
    one = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    model = line_crf.learn(docs, read(spark, SF, "labels"))
    want = set()
    for r in docs.collect():
        base = line_crf.base_rules(r["text"].encode())
        if not line_crf.base_failed(base[0], base[4]) and line_crf.content_share(r["text"].encode(), model) >= line_crf.KEEP_SHARE:
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == columns
    two = corpus_pipeline.language(spark, one, SF).cache()
    scored = language_id.with_language(one, language_id.learn(one))
    assert two.count() == scored.where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.MIN_MARGIN)).count() > 0.95 * one.count()
    three = corpus_pipeline.near_duplicates(spark, two, SF).cache()
    kept = [d for d, _, c in brute_links([tuple(r) for r in two.select("doc_id", "text").collect()]) if d == c]
    assert sorted(r["doc_id"] for r in three.collect()) == kept and three.columns == columns
    four = corpus_pipeline.repeated_strings(spark, three, SF).cache()
    removed = {d: (n - gone) for d, n, gone, *_ in brute_repeats([tuple(r) for r in three.select("doc_id", "text").collect()])}
    for r in four.collect():
        assert 0 <= removed[r["doc_id"]] - len(r["text"].encode()) <= 6 * 40 and r["n_chars"] == len(r["text"])
    assert four.columns == columns and four.count() == three.count()
    five = corpus_pipeline.packed(spark, four, SF)
    assert {r["doc_id"] for r in five.collect()} == set(kept)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() > 0


def test_stages_with_odd_rows(spark):
    """Null and empty texts, nulls in other columns, a repeated doc_id, ties, clashing columns and an empty table."""
    docs = read(spark, SF, "documents").limit(60)
    good = max((r["text"] for r in docs.where("lang = 'en'").collect()), key=len)
    odd = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (None, good, "en", "s", 1), (9003, "12 34 " * 30, "en", None, None), (9004, good + " tail", None, "s", 3), (9004, good + " tail", None, "s", 3)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for clash in ("score", "kept", "n_words", "lang_pred", "component_id", "n_removed", "length", "_text_print"):
        docs = docs.withColumn(clash, F.lit("clash"))
    docs = docs.cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.count() <= before.count() and docs.count() > 10
        if stage is corpus_pipeline.quality_rules:
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert not {9001, 9002} & set(ids) and ids.count(9004) in (0, 2)
            docs = docs.unionByName(spark.createDataFrame([odd[0], odd[1]], docs.schema)).cache()
        if stage is corpus_pipeline.language:
            assert docs.where("doc_id in (9001, 9002, 9003)").count() == 0
    pieces = corpus_pipeline.packed(spark, docs.unionByName(spark.createDataFrame([odd[0], odd[1]], docs.schema)), SF)
    assert {r["length"] for r in pieces.where("doc_id in (9001, 9002)").collect()} == {1}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
