import collections

import numpy as np

from adlift.llm.quality_rules import fit_forest, quality_rules, unusual
from tests.llm.helpers import WORD, odd

SF = "/root/testdata/sf0.01"


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_statistics_and_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base(r.text)
        assert not (g.base_failed and g.kept)
    good = [got[r.doc_id].kept for r in labels.where("quality = 1").collect() if not got[r.doc_id].base_failed]
    bad = [got[r.doc_id].kept for r in labels.where("quality = 0").collect()]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.2


def test_forest_isolates_outliers():
    x = np.random.default_rng(1).normal(size=(2000, 6))
    x[0] = 9
    s = unusual(fit_forest(x), x)
    assert s.argmax() == 0 and s[0] > 0.6 > np.median(s)


def test_odd_rows(spark):
    df = odd(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (8, 1), (8, 1)], "doc_id long, quality int")
    got = quality_rules(df, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == df.count() and by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[8].base_failed and by[8].n_words == 30_004
    assert by[None].n_words == 5
    assert quality_rules(df.limit(0), labels.limit(0)).count() == 0
