from pyspark.sql import functions as F

import corpus_pipeline as cp
from adlift.llm.language_id import learn, predict_language
from adlift.llm.mixing import mix_sources
from adlift.llm.sentencepiece_lattice import decode, load_model
from tests.llm.helpers import odd, shingles
from tests.llm.test_line_dedup import expected as lines_expected
from tests.llm.test_minhash import expected as groups_expected

SF = "/root/testdata/sf0.01"


def test_every_stage_does_the_whole_job(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES:
        seen.append(cp.written(stage(spark, seen[-1], SF), f"t-{name}"))
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    for df in seen[:-1]:
        assert df.columns == list(cp.COLUMNS)
    # language: everything clean stays, texts do not change
    assert all(rows[1][i].text == rows[0][i].text for i in rows[1])
    want = {r.doc_id for r in predict_language(docs, learn(docs)).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert set(rows[1]) == want and len(want) >= 0.98 * len(rows[0])
    # lines
    want = lines_expected([(i, r.text) for i, r in rows[1].items()])
    for i, r in rows[1].items():
        kept = want[i][0] - want[i][1]
        assert i in rows[2] and rows[2][i].text.count("\n") + 1 == kept or not shingles(rows[2][i].text if i in rows[2] else "", 1)
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    # near copies
    groups = groups_expected([(i, r.text) for i, r in rows[2].items()], 5)
    assert set(rows[3]) == {i for i, g in groups.items() if g[2]}
    # mixture
    want = {r.doc_id for r in mix_sources(seen[3], cp.TARGETS, budget=cp.BUDGET).collect() if r.kept}
    assert set(rows[4]) == want and 0.35 * len(rows[3]) < len(want) < len(rows[3])
    # pieces decode to the text
    back = {r.doc_id: r.text for r in decode(seen[5], load_model(cp.PIECES)).collect()}
    assert back == {i: r.text for i, r in rows[4].items()} and all(r.exact for r in rows[5].values())


def test_odd_rows(spark):
    df = odd(spark)
    for name, stage in cp.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
        df = cp.written(stage(spark, df, SF), f"t-{name}")
    assert {r.doc_id for r in df.collect()} <= {1, 2, 6, 7, 8, None}
    again = spark.createDataFrame([(1, "one two three four five six", "en", "s", 9)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.minhash_dedup(spark, again, SF).count() == 1
