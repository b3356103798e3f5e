import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from adlift.llm import queries
from adlift.llm.period_runs import _numbers, periodic_runs, runs_of
from tests.llm.helpers import ODD, WORD, odd

SF = "/root/testdata/sf0.01"


def brute(a, least=12):
    """(start, length, period) of every run, by comparing at every lag."""
    out = []
    for q in range(1, len(a) // 2 + 1):
        i = 0
        while i + q < len(a):
            j = i
            while j + q < len(a) and a[j] == a[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                run = a[i:j + q]
                if all(any(x != y for x, y in zip(run, run[p:])) for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    drop = set()
    for s, length, q in runs:
        drop.update(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in
           ("".join(f"{s},{k},{q}\n" for s, k, q in runs), " ".join(x for i, x in enumerate(w) if i not in drop))]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)


def periodic(rng, n, letters):
    a = []
    while len(a) < n:
        a += [rng.randrange(letters) for _ in range(rng.randint(1, 30))] * rng.randint(1, 6)
        if rng.random() < 0.3:
            a[rng.randrange(len(a))] = rng.randrange(letters)
    return a[:n]


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        docs = sorted((periodic(rng, rng.randint(0, 150), rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(1, 4))), key=len)
        least = rng.choice([12, 12, 2, 5, 7])
        a, start = _numbers(docs)
        got = [(s, e - s, q) for s, e, q in runs_of(a, least, start)]
        want = [(s + o, k, q) for d, o in zip(docs, start.tolist()) for s, k, q in brute(d, least)]
        assert sorted(got) == sorted(want)


def test_one_word_and_double_periods_stay_cheap():
    import time
    begin = time.time()
    assert runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    word = np.random.default_rng(0).integers(0, 2, 5000)
    assert (0, 50_000, 5000) in runs_of(np.tile(word, 10))
    assert time.time() - begin < 20


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in periodic(rng, rng.randint(0, 90), rng.choice([2, 3, 40])))) for i in range(150)]
    rows += [(None, "a b " * 9), (150, None), (150, ""), (151, " \t\n"), (151, "é " * 14 + "x\x0by z"), (152, "a b c d e f " * 2)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_period_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 60


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 3000]
    got = {r.doc_id: tuple(r) for r in queries.op13_period_runs(spark, SF).collect()}
    assert all(got[d] == expected(d, t) for d, t in rows)


def test_odd_rows(spark):
    df = odd(spark).withColumns({c: F.lit("x") for c in ("runs", "collapsed", "start", "period")})
    got = sorted(map(tuple, periodic_runs(df).collect()), key=str)
    want = sorted(((r[0], [tuple(x) for x in brute((r[1] or "").split())] if r[0] != 8 else [(0, 30_000, 1)],
                    "long Ünï côdé 漢字 🙂" if r[0] == 8 else " ".join(WORD.findall(r[1] or ""))) for r in ODD), key=str)
    assert [(a, [tuple(x) for x in b], c) for a, b, c in got] == want
    assert periodic_runs(df.limit(0)).count() == 0
