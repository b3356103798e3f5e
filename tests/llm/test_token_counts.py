import uuid

from pyspark.sql import functions as F

from adlift.llm.common import shared_dir
from adlift.llm.token_counts import Ledger, count_tokens, deltas
from tests.llm.helpers import odd, words


def test_batches_commit_once(spark):
    ledger = Ledger(spark, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    base = count_tokens(odd(spark)).withColumns({"kind": F.lit("insert"), "old_tokens": F.lit(None).cast("long")})
    assert ledger.commit("a", base) and not ledger.commit("a", base)
    n = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals(["a"]).collect()}
    assert n["s0", "en"] == (5, 12 + 30_004 + 3) and n["", ""] == (1, 6) and n["s1", "fr"] == (2, 0)
    gone = base.where("source = 's1'").withColumn("kind", F.lit("delete"))
    new = base.where("doc_id = 8").withColumns({"kind": F.lit("revise"), "old_tokens": F.col("n_tokens"), "n_tokens": F.lit(4)})
    assert ledger.commit("b", gone.unionByName(new))
    n = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals(["a", "b", "never"]).collect()}
    assert n["s0", "en"] == (5, 12 + 4 + 3) and ("s1", "fr") not in n
    assert ledger.commit("empty", base.limit(0)) and ledger.totals([]).count() == 0
    assert deltas(base.withColumn("kind", F.lit(None).cast("string"))).count() == 0


def test_counts(spark):
    rows = {r.doc_id: r.n_tokens for r in count_tokens(odd(spark)).collect()}
    assert all(rows[r.doc_id] == len(words(r.text)) for r in odd(spark).collect())


def test_query_with_odd_labels(spark, tmp_path):
    """Null and repeated label ids, labels without documents, repeated documents: each row is judged by the worst of its labels."""
    from adlift.llm import oracle, queries
    import duckdb
    odd(spark).select("doc_id", "text", "lang", "source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 1), (1, 1, 0), (2, 0, 1), (2, 1, None), (None, 0, 1), (6, None, 1), (8, None, None), (99, 0, 0), (9, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.op9_token_counts(spark, str(tmp_path))
    want = con.execute(oracle.TOKEN_COUNTS)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(r for r in want.fetchall() if r[3] or r[4])
