import corpus_pipeline as cp


def test_without_languages_texts_stay(spark):
    rows = [(1, "some words"), (2, "漢字"), (3, "12 !!"), (4, None), (None, "é")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.language_id(spark, docs, "")
    assert out.columns == list(cp.COLUMNS) and {r.doc_id for r in out.collect()} == {1, 2, None}
