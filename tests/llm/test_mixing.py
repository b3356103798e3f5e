from pyspark.sql import functions as F

from adlift.llm import mixing
from adlift.llm.mixing import mix_sources, rake
from tests.llm.helpers import odd

SF = "/root/testdata/sf0.01"


def test_marginals_are_met(spark):
    cells = spark.createDataFrame([(s, x, t, n) for s, a in (("a", 900), ("b", 50), ("c", 50)) for x, b in (("en", 2), ("fr", 1))
                                   for t, n in (("p", a * b), ("q", a + b))], "source string, lang string, topic string, tokens long")
    goals = {"source": {"a": 0.3, "b": 0.4, "c": 0.3}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"p": 0.7, "q": 0.3}}
    raked = rake(cells, goals, sweeps=25)
    for dim, want in goals.items():
        got = {r[0]: r[1] for r in raked.groupBy(dim).agg(F.sum("weight")).collect()}
        assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())


def test_sampled_tokens_follow_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select(*[F.col(c) for c in docs.columns if c != "doc_id"], F.explode(F.sequence(F.lit(1), F.lit(20))).alias("doc_id"))
    docs = docs.withColumn("doc_id", F.monotonically_increasing_id())
    out = mix_sources(docs, {"lang": {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25}}).cache()
    kept = {r[0]: r[1] for r in out.where("kept").groupBy("lang").agg(F.sum("tokens")).collect()}
    assert all(abs(v / sum(kept.values()) - 0.25) < 0.04 for v in kept.values())


def test_budget_is_met_and_moves_towards_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    goals = {"source": {"src0": 0.5}, "lang": {"de": 0.4}}
    out = mix_sources(docs, goals, budget=0.6).cache()
    total, kept = out.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
    assert abs(kept / total - 0.6) < 0.01
    strict = mix_sources(docs, goals).agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    assert strict < 0.3 * total
    for dim, value in (("source", "src0"), ("lang", "de")):
        had, has = out.where(F.col(dim) == value).agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability"))).first()
        assert had / total < has / kept


def test_odd_rows(spark):
    df = odd(spark)
    got = mix_sources(df, {"source": {"s0": 0.5, "absent": 0.5}, "lang": {"en": 0.5}}, carry=True).collect()
    assert len(got) == df.count() and all(0 <= r.probability <= 1 for r in got)
    assert {r.probability for r in got if r.doc_id == 1} and len({(r.probability, r.kept) for r in got if r.doc_id == 1}) == 1
    assert all(r.row.score == "x" for r in got)
    assert {r.lang for r in got if r.doc_id == 2} == {""}
    assert mix_sources(df.limit(0), {"lang": {"en": 1.0}}).count() == 0
    assert mix_sources(df.limit(0), {"lang": {"en": 1.0}}, budget=0.5).count() == 0
    assert all(0 <= r.probability <= 1 for r in mix_sources(df, {"lang": {"en": 0.5}}, budget=0.9).collect())


def test_no_step_holds_the_plan_of_the_one_before(spark, monkeypatch):
    """Plans and broadcast tables of the sweeps fill the driver where every step repeats those before it."""
    joins = []

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return written(df, name)
    written = mixing.written
    monkeypatch.setattr(mixing, "written", counted)
    cells = spark.createDataFrame([(s, x, t, 10) for s in "ab" for x in "cd" for t in "ef"], "source string, lang string, topic string, tokens long")
    raked = rake(cells, {"source": {"a": 0.3}, "lang": {"c": 0.6}, "topic": {"e": 0.9}}, sweeps=4)
    assert len(joins) == 2 + 4 * 3 and max(joins[2:]) == 1 and joins[:2] == [0, 3]
    got = {(r.source, r.lang, r.topic): r.weight for r in raked.collect()}
    assert abs(got["a", "c", "e"] - 0.3 * 0.6 * 0.9) < 1e-9 and abs(sum(got.values()) - 1) < 1e-9


def test_a_sweep_of_missing_and_single_values(spark):
    cells = spark.createDataFrame([("a", "", "p", 5), ("b", "", "p", 0)], "source string, lang string, topic string, tokens long")
    (row,) = rake(cells, {"source": {"b": 0.9}, "lang": {"en": 0.5}}).collect()
    assert (row.source, row.tokens, round(row.weight, 12)) == ("a", 5, 1.0)
    assert rake(cells.limit(0), {"source": {"b": 0.9}}).collect() == []
