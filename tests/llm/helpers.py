"""Brute-force twins and small fixtures for the training-data operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def smallest_reachable(ids, pairs):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s0", 5),
    (1, "alpha beta gamma delta epsilon zeta", "en", "s0", 5),
    (2, "ALPHA beta  gamma\tdelta epsilon zeta", None, None, None),
    (3, None, "en", "s0", None),
    (4, "", "fr", "s1", 0),
    (5, " \n\t ", "fr", "s1", 4),
    (6, "alpha beta", "en", None, 10),
    (7, "Alpha BETA", None, "s1", 10),
    (None, "only one without an id", "de", "s2", 1),
    (8, "long " * 30_000 + "Ünï côdé 漢字 🙂", "en", "s0", 9),
    (9, "1234 5678 !!", "en", "s0", 12),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and clashing extra columns."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    names = ("node", "root", "key", "n", "a", "b", "kept", "component_id", "score", "word", "words", "n_words",
             "block", "line", "id", "value", "weight", "topic", "tokens", "html", "label")
    return df.withColumns({c: F.lit("x") for c in names})
