import numpy as np
import zlib

from adlift.llm.language_id import learn, mixture, predict_language
from adlift.llm.queries import op10_language_id
from tests.llm.helpers import odd

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op10_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in out]) >= 0.98


def test_two_languages_in_one_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs)
    by = {r.lang: r.text for r in docs.where("n_chars between 2000 and 2600").orderBy("doc_id").collect()}
    df = spark.createDataFrame([(1, by["fr"] + " " + by["de"])], "doc_id long, text string")
    r = predict_language(df, model).first()
    assert set(r.langs) == {"fr", "de"} and 0.35 < r.score < 0.65 and abs(sum(r.shares) - 1) < 1e-6


def test_mixture_prefers_fewer_languages():
    same = np.tile(np.log([[0.3, 0.29, 0.3]]), (50, 1))
    assert mixture(same, np.ones(50), 3.0)[0].tolist() == [0]


def test_odd_rows(spark):
    df = odd(spark)
    model = learn(df.where("doc_id < 100"))
    got = sorted(map(tuple, predict_language(df, model).select("doc_id", "lang_pred", "score").collect()), key=str)
    assert len(got) == df.count()
    by = {r[0]: r[1:] for r in got}
    assert by[3] == by[4] == by[5] == by[9] == ("und", 0.0)
    assert by[8][0] == "en" and by[None][0] in model[0]
    none = learn(df.limit(0))
    assert none[0] == [] and {r.lang_pred for r in predict_language(df, none).collect()} == {"und"}
    assert predict_language(df.limit(0), model, carry=True).count() == 0


def test_query_takes_null_ids_as_training(spark, tmp_path):
    from adlift.llm.queries import op10_language_id
    rows = [(None if i % 5 == 0 else i, t, lang) for i in range(40) for t, lang in (("the cat and the dog", "en"), ("le chat et le chien", "fr"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 80 and all(r.held_out is not None for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
