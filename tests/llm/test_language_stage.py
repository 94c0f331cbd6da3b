import corpus_pipeline as cp


def test_documents_with_letters_stay_where_no_language_is_known(spark):
    rows = [(1, "some words here", None, "s", 15), (2, "12 34", None, "s", 5), (3, None, None, "s", None), (4, "Wörter", None, "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.language_stage(spark, docs, "").collect()) == [1, 4]
