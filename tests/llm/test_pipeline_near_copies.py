"""Near copies go by row: shared and null ids do not take other texts along."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(word):
    return " ".join(f"{word}{i}" for i in range(40))


def test_null_and_shared_ids(spark):
    near = text("a") + " more"
    rows = [(None, text("n")), (None, text("m")), (None, text("n")), (None, text("a")),
            (1, text("a")), (2, near), (2, text("b")), (5, text("c")), (5, text("d")), (5, text("c")), (7, None), (8, " "), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(4)
    out = cp.minhash_dedup(spark, docs, SF)
    assert out.columns == list(cp.COLUMNS)
    want = [(None, text("n")), (None, text("m")), (1, text("a")), (2, text("b")), (5, text("c")), (5, text("d")), (7, None), (8, " "), (None, None)]
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(want, key=key)
