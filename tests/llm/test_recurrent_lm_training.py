"""Every training document reaches the weights."""

import numpy as np
from pyspark.sql import functions as F

from adlift.llm import recurrent_lm as lm


def test_round_passes_over_all_documents(spark):
    head = [(lm.END, 500), (b"a", 400), (b"b", 300)]
    shape = lm.Shape(head)
    flat = shape.start(head, np.full(lm.TAIL, 5))
    texts = ["a b a b"] * 300 + ["a " * 1200, "", None] + ["other words"] * 50
    learn = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary")).repartition(3)
    got = lm.train_round(learn, shape, flat, shard=400).toPandas()
    assert len(got) == shape.size and set(got["n"]) == {sum(len((t or "").split()) + 1 for t in texts)}
    assert np.isfinite(got["w"]).all() and not np.allclose(got.sort_values("k")["w"], flat)


def test_no_training_document_is_left_out(spark, monkeypatch):
    """A corpus over the size of the former sample: every round is given all training rows."""
    seen = []
    whole_round = lm.train_round
    monkeypatch.setattr(lm, "train_round", lambda learn, *a: seen.append(learn.count()) or whole_round(learn, *a))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("repeat('some words here ', 300)").alias("text"))
    assert lm.score_documents(docs, F.expr("doc_id % 5 <> 1")).count() == 2000
    assert seen == [1600] * lm.ROUNDS


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """The same rows in other partitions and another order, over several shards: the same scores."""
    monkeypatch.setattr(lm, "SHARD", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rule = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    one, other = (
        {r.doc_id: r.score for r in lm.score_documents(d, rule).collect()}
        for d in (docs.coalesce(1), docs.repartition(7, F.rand(3))))
    assert one.keys() == other.keys() and len(one) == docs.count()
    assert max(abs(one[k] - other[k]) / abs(one[k]) for k in one) < 1e-6


def test_parts_of_a_document_follow_each_other():
    """A document in parts is the same stream, so training on it differs only where states start anew."""
    head = [(lm.END, 50), (b"a", 40), (b"b", 30)]
    shape = lm.Shape(head)
    flat = shape.start(head, np.ones(lm.TAIL))
    doc = np.random.default_rng(0).integers(0, 3, 3000)
    whole = lm.train(shape, flat, [doc], [0])
    parts = lm.train(shape, flat, [doc[:1000], doc[1000:]], [0, int(doc[999])])
    assert np.isfinite(parts).all() and np.abs(whole - parts).max() < 0.5 and not np.allclose(parts, flat)
