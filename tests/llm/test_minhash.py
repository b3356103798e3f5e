import itertools

import pytest

from adlift.llm.minhash_dedup import minhash_groups
from tests.llm.helpers import ODD_SCHEMA, odd, shingles, smallest_reachable

SF = "/root/testdata/sf0.01"


def expected(rows, n, percent=80):
    sets = {i: shingles(t, n) for i, t in rows}
    by_first = {}
    for i, s in sets.items():
        for x in s:
            by_first.setdefault(x, []).append(i)
    pairs = set(itertools.chain.from_iterable(itertools.combinations(sorted(v), 2) for v in by_first.values()))
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = smallest_reachable(sets, links)
    return {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("n", [4, 5])
def test_groups_equal_brute_force(spark, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_groups(docs, words=n).collect()}
    assert got == expected(rows, n)
    assert any(v[1] != k for k, v in got.items())


def test_chain_of_copies_in_one_bucket(spark):
    """A chain whose ends share too little, and a hot group of copies: blocks must join what the stars miss."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(12):
        base = base[:]
        for j in range(4):
            base[(k * 16 + j * 4) % 200] = f"n{k}.{j}"
        texts.append(" ".join(base))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[3]) for i in range(300)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], ODD_SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_groups(docs, words=4).collect()}
    assert got == expected(rows, 4)


def test_odd_rows(spark):
    got = sorted(map(tuple, minhash_groups(odd(spark), words=5).collect()), key=str)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert by[1] == [(2, 1, True)] * 2 and by[2] == [(2, 1, False)]
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[6] == [(1, 6, True)] and by[7] == [(1, 6, False)]
    assert by[None] == [(1, None, True)] and by[8][0][1:] == (8, True)
    assert minhash_groups(odd(spark).limit(0)).count() == 0
