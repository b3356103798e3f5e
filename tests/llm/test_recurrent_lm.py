import collections
import math
import zlib

import numpy as np
import pytest

from adlift.llm import recurrent_lm as lm
from adlift.llm.queries import op3_recurrent_lm
from tests.llm.helpers import odd, words

SF = "/root/testdata/sf0.01"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def base_scores(rows):
    count = collections.Counter()
    for i, t in rows:
        if not held(i):
            count.update(words(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        tokens = words(t) + [None]
        out.append((i, held(i), len(tokens), sum(w in count for w in tokens), n,
                    sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return out


def test_counts_base_and_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r[0]: r[1:] for r in base_scores([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])}
    got = {r.doc_id: r for r in op3_recurrent_lm(spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)   # scores are negative
    assert all(r.score < 0 for r in out)


def tiny():
    head = [(b"a", 50), (b"b", 40), (lm.END, 30), (b"c", 5)]
    shape = lm.Shape(head)
    return shape, shape.start(head, np.ones(lm.TAIL))


def test_probabilities_sum_to_one():
    shape, flat = tiny()
    h = np.random.default_rng(0).normal(size=(3, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(lm.log_probabilities(shape, shape.split(flat), h, np.full(3, s))[0]) for s in range(4 + lm.TAIL))
    assert np.allclose(total, 1, atol=1e-5)


def test_score_is_that_of_the_whole_text():
    """Windows and lanes against one step at a time."""
    shape, flat = tiny()
    p, rng = shape.split(flat), np.random.default_rng(2)
    docs = [rng.integers(0, 4 + lm.TAIL, n) for n in (1, 31, 32, 33, 100, 7)]
    table = p["emb"] @ p["wx"] + p["b"]
    for d, got in zip(docs, lm.score(shape, p, docs)):
        h, last, total = np.zeros((1, lm.HIDDEN), np.float32), shape.head[lm.END], 0.0
        for s in d:
            h = lm._cell(table[[last]], h, p["wh"])[0]
            total += lm.log_probabilities(shape, p, h, np.array([s]))[0][0]
            last = s
        assert got == pytest.approx(total, rel=1e-4)


def test_training_follows_the_gradient():
    """An alternating pattern is learnt."""
    shape, flat = tiny()
    docs = [np.array([0, 1, 0, 1, 0, 1, 2]) for _ in range(200)]
    before = lm.score(shape, shape.split(flat), docs[:1])[0]
    for _ in range(60):
        flat = lm.train(shape, flat, docs)
    assert lm.score(shape, shape.split(flat), docs[:1])[0] > before / 3


def test_odd_rows(spark):
    from pyspark.sql import functions as F
    df = odd(spark)
    rule = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in
                  lm.score_documents(df, rule).collect()), key=str)
    want = sorted(((*r[:5], round(r[5], 6)) for r in base_scores([(r.doc_id, r.text) for r in df.collect()])), key=str)
    assert got == want
    assert lm.score_documents(df.limit(0), rule).count() == 0
    none = lm.score_documents(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in none)
