"""The pipeline stage by stage on a small table."""

import os
import random

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) <= before, name
        docs, before = spark.createDataFrame(rows, out.schema), len(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before > 0 and last.where("not round_trip").count() == 0


def test_clean_documents_stay(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choice(["an", "er", "to", "li", "ne"]) for _ in range(4)) + rng.choice(["", "", "."]) for _ in range(80))
    rows = [(i, text(), "en", "s", 1) for i in range(30)] + [(50, None, None, None, None), (51, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(30))


def test_passage_is_cut_among_long_pieces_of_it(spark):
    rng = random.Random(23)
    own = [f"p{rng.randrange(10**6)}" for _ in range(80)]
    text = lambda middle: " ".join([*(f"h{rng.randrange(10**6)}" for _ in range(30)), *middle, *(f"t{rng.randrange(10**6)}" for _ in range(30))])
    rows = [(100, text(own)), (200, text(own))]
    for doc in (*range(1, 60), *range(101, 160), *range(201, 260)):
        at = rng.randrange(36)
        rows.append((doc, text(own[at : at + 45])))
    left = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    size = {r["doc_id"]: len(r["text"].split()) for r in left.collect()}
    assert size == {doc: 60 if doc == 200 else len(t.split()) for doc, t in rows}
