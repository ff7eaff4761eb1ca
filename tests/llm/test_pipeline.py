import corpus_pipeline
from tests.llm.test_operators import BASE, NEAR


def test_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate([BASE, BASE.upper(), NEAR, None, "", "a clean text of its own kind"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == names
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert len(kept["exact_dedup"]) == len(kept["toxicity"]) - 2 and 0 not in kept["exact_dedup"]
    assert len(kept["near_dedup"]) == 3 and 5 in kept["near_dedup"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == set(kept["mixing"])


def test_every_stage_takes_an_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
