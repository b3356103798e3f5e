"""Quality rules by an isolation forest on rule statistics.

One scan computes the statistics of every whole text. The forest's trees are
random splits over subsamples of ``TREE_ROWS`` rows (the method's own bound,
``TREES`` x ``TREE_ROWS`` rows in all, those with the smallest hashes); a short
mean path marks an unusual document. Only documents that pass the base rules
train the forest. The cut is calibrated on all labelled rows: of the cuts that
lose at most ``most_lost`` of the good documents, the one that finds most bad
ones, and of several the highest; without labels of both kinds the cut is 1 and nothing more is dropped.

Defined results: null text has no words and fails the base rules. Rows are
independent, so repeated rows and null ids keep their rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.common import map_rows, mix, small_batches, smallest, word_hashes, written

TREES = 100
TREE_ROWS = 256
# Statistic of each rule, as the amount beyond the rule's customary limit: mean word length outside 2.5 to 12,
# symbols a word over 0.1, repeated lines over half, capitals over 0.3 of the letters, marks over 0.3 of the
# characters, distinct words under a tenth. Usual documents are all zero, so only rule breaks can isolate a row.
FEATURES = ("word_length", "symbols", "dup_lines", "capitals", "marks", "distinct")
_KIND = np.zeros(256, dtype=np.uint8)          # 1 symbol, 2 A-Z, 3 a-z, 4 other ASCII marks
_KIND[[ord(c) for c in "!\"'()+,-./:;=?@[\\]^_`{}~"]] = 4
_KIND[list(range(65, 91))] = 2
_KIND[list(range(97, 123))] = 3
_KIND[[ord(c) for c in "#*$%&|<>"]] = 1


def _over(value: float, limit: float) -> float:
    return max(0.0, float(value) - limit)


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """Counts (words, word characters, symbols, duplicate lines, repeated words) and the forest's features."""
    words = word_hashes(text)
    n = len(words)
    a = np.frombuffer(text, dtype=np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    chars = int((((a & 0xC0) != 0x80) & ~space).sum())
    kinds = np.bincount(_KIND[a], minlength=5) if len(a) else np.zeros(5, dtype=np.int64)
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n >= 3:
        window = mix(mix(mix(words[:-2]) + words[1:-1]) + words[2:])
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
        cover = np.zeros(n + 1, dtype=np.int64)
        hit = np.flatnonzero(count[back] > 1)
        np.add.at(cover, hit, 1)
        np.add.at(cover, np.minimum(hit + 3, n), -1)
        repeated = int((np.cumsum(cover[:n]) > 0).sum())
    letters = max(1, int(kinds[2] + kinds[3]))
    mean = chars / n if n else 0.0
    features = [max(mean - 12, 2.5 - mean, 0.0), _over(kinds[1] / max(1, n), 0.1), _over(dup / max(1, len(lines)), 0.5),
                _over(kinds[2] / letters, 0.3), _over(kinds[4] / max(1, chars), 0.3),
                max(0.0, 0.1 - len(np.unique(words)) / n) if n else 0.0]
    return [n, chars, int(kinds[1]), dup, repeated], [float(x) for x in features]


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """A tree as nodes (feature, cut, left, right, path length of a leaf); a leaf has feature -1."""
    nodes: list = []
    limit = int(np.ceil(np.log2(max(2, len(rows)))))

    def build(x: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        wide = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 else []
        if depth >= limit or not len(wide):
            nodes[at] = (-1, 0.0, at, at, depth + _path(len(x)))
            return at
        f = int(rng.choice(wide))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        left = x[:, f] <= cut
        nodes[at] = (f, float(cut), build(x[left], depth + 1), build(x[~left], depth + 1), 0.0)
        return at

    build(rows, 0)
    return nodes


def fit_forest(rows: np.ndarray, seed: int = 11) -> list[list[tuple]]:
    rng = np.random.default_rng(seed)
    size = min(TREE_ROWS, len(rows))
    return [grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(TREES)] if size else []


def unusual(forest: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Isolation score in (0, 1]; near 1: isolated by few splits."""
    if not forest or not len(x):
        return np.zeros(len(x))
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for tree in forest:
        feature, cut, left, right, path = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := feature[at] >= 0).any():
            go = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
            at = np.where(inner, go, at)
        total += path[at]
    return 2.0 ** (-total / len(forest) / max(_path(TREE_ROWS), 1e-9))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  least_words: int = 50, most_repeated: int = 50, most_lost: float = 0.002) -> DataFrame:
    """Base rules, then the calibrated forest.

    ``labels`` has doc_id and quality (0 or 1; nulls are left out; a document is
    bad if any of its labels says so). Returns doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, unusual, cut, kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").cast("binary").alias("text"))

    def make():
        def work(rows: dict) -> dict:
            done = [statistics(t or b"") for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "features": [d[1] for d in done]} | {
                k: [d[0][i] for d in done] for i, k in enumerate(names)}
        return work

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", features array<double>"
    stats = map_rows(docs, schema, make).withColumn("base_failed", F.expr(
        f"n_words < {least_words} or 100 * n_repeat_words > {most_repeated} * n_words"))
    stats = written(stats, "statistics")
    key = F.unhex(F.md5(F.concat_ws(",", "doc_id", "n_words", "word_chars")))
    sample = smallest(stats.where("not base_failed").select(key.alias("key"), "features"), "key", TREES * TREE_ROWS).select("features").collect()
    forest = spark.sparkContext.broadcast(fit_forest(np.array([r.features for r in sample]).reshape(-1, len(FEATURES))))

    def scorer():
        def work(rows: dict) -> dict:
            x = np.array(rows.pop("features"), dtype=np.float64).reshape(-1, len(FEATURES))
            return rows | {"unusual": unusual(forest.value, x).tolist()}
        return work

    kinds = ", ".join(f"{k} long" for k in names)
    scored = map_rows(stats, f"doc_id long, {kinds}, base_failed boolean, unusual double", scorer)
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    table = (scored.where("not base_failed").join(marks, "doc_id")
             .groupBy(F.ceil(F.col("unusual") * 1000).cast("int").alias("at"))
             .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect())
    good, bad = np.zeros(1002), np.zeros(1002)
    for r in table:
        good[r["at"]], bad[r["at"]] = r.good, r.bad
    cut = 1.0
    if good.sum() and bad.sum():
        lost = np.cumsum(good[::-1])[::-1] / good.sum()      # share of good rows above cut i - 1
        fine = np.flatnonzero(lost <= most_lost)
        found = np.cumsum(bad[::-1])[::-1]
        cut = (int(fine[found[fine] == found[fine[0]]][-1]) - 1) / 1000
    return scored.withColumn("cut", F.lit(cut)).withColumn("kept", F.expr("not base_failed and unusual <= cut"))
