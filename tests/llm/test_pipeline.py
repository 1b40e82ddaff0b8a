"""The pipeline's stages on the smallest tables and on awkward rows."""

from collections import Counter

import pytest

from sievework.session import materialise
from tests.llm.fixtures import SCHEMA, empty, jaccard_groups, labels, removed_words, rows, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_plain_definitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = materialise(stage(spark, docs, sf), "test-stage")
        if name == "best-fit packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality rules":
            assert n * 0.5 < len(after) < n
        if name == "exact dedup":
            best = {}
            for i, t in before.items():
                best[t] = max(i, best.get(t, i))
            assert set(after) == set(best.values())
        if name == "n-gram Jaccard join":
            assert set(after) == {i for i, least, _ in jaccard_groups(before.items()) if i == least}
        if name == "substring dedup":
            gone = removed_words(before.items())
            for i, t in before.items():
                g = gone[i, t]
                if not any(g):
                    assert after[i] == t
                elif all(g):
                    assert i not in after
                else:
                    assert after[i] == " ".join(w for w, x in zip(words(t), g, strict=True) if not x)


def awkward_folder(spark, path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels(spark).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    folder = awkward_folder(spark, tmp_path / "a")
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and all(1 <= r["length"] <= 2048 for r in got)
    assert not Counter(r["doc_id"] for r in got)[14]
    empty(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels(spark).limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_every_stage_takes_awkward_rows(spark, tmp_path):
    folder = awkward_folder(spark, tmp_path / "c")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, folder)
        out.collect()
        if name != "best-fit packing":
            assert out.columns == df.columns
