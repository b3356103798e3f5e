import hashlib

from pyspark.sql import functions as F

from adlift.llm.line_dedup import drop_repeated_lines
from tests.llm.helpers import LOWER, odd

SF = "/root/testdata/sf0.01"


def expected(rows):
    def key(line):
        k = line.strip(" \t\n\v\f\r").translate(LOWER)
        return k if len(k) >= 10 else None
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def digest(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.h) for r in
            df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h")).collect()}


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = expected(rows)
    assert sum(v[1] for v in want.values()) > 100
    assert digest(drop_repeated_lines(docs.repartition(5))) == want


def test_full_filter_is_still_exact(spark):
    rows = [(i, "\n".join(f"  line NUMBER {(i * 7 + j) % 900} \r" for j in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    assert digest(drop_repeated_lines(docs, max_bits=1 << 10)) == expected(rows)


def test_odd_rows(spark):
    got = drop_repeated_lines(odd(spark), carry=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.text))
        assert r.row.score == "x"
    assert [x[:2] for x in by[1]] == [(1, 0)] * 2
    assert by[2] == [(1, 0, "ALPHA beta  gamma\tdelta epsilon zeta")]
    assert by[3] == by[4] == [(1, 0, "")] and by[5] == [(2, 0, " \n\t ")]
    assert by[6][0][1] == 0 and by[7] == [(1, 1, "")] and by[None] == [(1, 0, "only one without an id")]
    assert len(by[8][0][2]) > 150_000
    assert drop_repeated_lines(odd(spark).limit(0)).count() == 0
