"""The pipeline's stages on planted documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import edited, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    passage, item = prose(5000, 60), prose(6000, 40)
    rows = []
    for i in range(300):
        text = prose(i, 80)
        if i % 5 == 1:
            text += ". You vile w1 person."
        if i in (7, 17, 27):
            text += " " + item
        if i in (10, 20, 30):
            text += " " + passage
        rows.append((i, text, "en", "s", len(text)))
    copy = edited(rows[40][1], 1, 1)
    rows += [(400, rows[40][1], "en", "s", 1), (401, copy, "en", "s", 1), (402, None, "en", "s", None), (403, "", None, None, 0), (403, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i % 5 == 1)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    from batchloom.llm.durable import written

    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, folder))
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = out
    toxic = {i for i in range(300) if i % 5 == 1}
    assert seen["toxicity"] == set(range(300)) - toxic | {400, 402, 403} | ({401} if 401 in seen["toxicity"] else set())
    assert seen["near_duplicates"] == seen["toxicity"] - {400, 401}
    assert seen["substring_dedup"] == seen["near_duplicates"] and seen["decontamination"] == seen["substring_dedup"] - {7}  # the dedup has taken the item from 17 and 27
    assert seen["sentencepiece"] == seen["decontamination"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts[10].split()) == 140 and len(texts[20].split()) == 80 and texts[11 + 1] == prose(12, 80)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0 and out.count() > 200


def test_run_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
