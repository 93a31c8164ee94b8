"""The pipeline: each stage keeps its contract, and the last gives the tokens of what is left."""

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        after = spark.read.parquet(out)
        if name != "encoding":
            assert after.columns == COLUMNS and 0 < after.count() <= docs.count()
        else:
            assert after.count() == docs.count()
        docs = after
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.createDataFrame(
        [(i, f"Plain words of the text number {'abcdefghijklmno'[i]} that is like no other {i * 7919}", "en", "s", 1) for i in range(9)] + [(90, "12 !!", "en", "s", 1), (91, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in docs.collect()) == list(range(9))


def test_extra_columns_pass_through(spark, sf_dir):
    extra = ["removed", "_id", "_mark", "_removed", "kept", "component", "score", "lang_pred", "n_words", "items", "print", "rep"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    docs = docs.select("*", *[docs["lang"].alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == COLUMNS + extra, name
    assert docs.filter("removed <> lang").count() == 0 and corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() > 0


def test_empty_documents(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
