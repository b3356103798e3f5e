"""Language mixture of a document by expectation-maximisation over n-gram likelihoods.

Training counts hashed byte trigrams of words by language over every training
row (partial sums per task, then one grouped sum). A document is a mixture: each
word comes from one language of an unknown set. EM estimates the proportions for
nested sets, ordered by the proportions of the full mixture; the set with the
best likelihood less ``penalty`` * log(words) for each further language is
chosen. The model has at most ``BUCKETS`` values a language.

Defined results: a text that is null or has no letter gets ``und`` and score 0,
as does every text when nothing can be learned. Rows are independent, so
repeated rows and null ids keep their rows. Ties go to the alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from adlift.llm.common import small_batches

BUCKETS = 1 << 15
SMOOTH = 0.1
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of a text in order, and where each word's trigrams begin."""
    words = text.translate(_LETTERS).split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    h = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA6B) ^ a[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    h = (h >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)
    middle = a[1:-1] != 32     # a trigram belongs to the word of its middle byte
    start = np.flatnonzero(middle & (a[:-2] == 32))
    return h[middle], (np.cumsum(middle) - 1)[start]


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode(errors="ignore"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            grams, _ = _grams(text)
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
            sums[lang] += np.bincount(grams, minlength=BUCKETS)
    for lang, n in sums.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()),
                                          "bucket": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each bucket and language) from rows with text and lang."""
    rows = docs.where("text is not null and lang is not null").select("lang", F.col("text").cast("binary").alias("text"))
    table = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = table.toPandas()    # at most BUCKETS rows a language
    langs = sorted(table["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[table["bucket"].to_numpy(dtype=np.int64), table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = table["n"]
    return langs, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * BUCKETS))


def _em(like: np.ndarray, size: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Proportions by size and the mixture log-likelihood; like: (words, languages), scaled to a row maximum of 1."""
    share = np.full(like.shape[1], 1 / like.shape[1])
    last = -np.inf
    for _ in range(steps):
        joint = like * share
        total = joint.sum(axis=1)
        value = float(np.log(total).sum())
        if value - last < 1e-3:
            break
        last = value
        share = size @ (joint / total[:, None])
        share /= share.sum()
    return share, value


def mixture(log_like: np.ndarray, size: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(chosen languages by falling proportion, their proportions) from (words, languages) log-likelihoods."""
    top = log_like.max(axis=1)
    scaled = log_like - top[:, None]
    alone = scaled.sum(axis=0)
    best = int(alone.argmax())
    cost = penalty * np.log(len(size) + 1)
    chosen, shares, value = np.array([best]), np.ones(1), alone[best]
    if -value > cost and log_like.shape[1] > 1:     # else no mixture can gain enough: words at their best give 0
        like = np.exp(np.maximum(scaled, -60))
        full, _ = _em(like, size)
        order = np.argsort(-full, kind="stable")
        for k in range(2, len(order) + 1):
            share, total = _em(like[:, order[:k]], size)
            if total - cost * (k - 1) <= value:
                break
            chosen, shares, value = order[:k], share, total - cost * (k - 1)
    by = np.argsort(-shares, kind="stable")
    return chosen[by], shares[by]


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id",
                     text_col: str = "text", penalty: float = 6.0, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (its proportion), langs and shares (the chosen set); ``carry`` adds the input row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    row = F.struct(*docs.columns) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").cast("binary").alias("text"), row.alias("row"))
    empty = "cast(null as string) lang_pred", "cast(0 as double) score", "array('') langs", "array(0d) shares"
    schema = docs.selectExpr("doc_id", "row", *empty).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            pred, score, sets, shares = [], [], [], []
            for text in batch.column("text").to_pylist():
                grams, start = _grams(text or b"")
                if not len(langs) or not len(start) or not _has_letter(text[:256]) and not _has_letter(text):
                    pred.append("und")
                    score.append(0.0)
                    sets.append([])
                    shares.append([])
                    continue
                size = np.diff(np.append(start, len(grams)))
                which, part = mixture(np.add.reduceat(table[grams], start, axis=0), size, penalty)
                pred.append(langs[which[0]])
                score.append(min(1.0, float(part[0])))
                sets.append([langs[i] for i in which])
                shares.append(part.tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row").cast(arrow.field("row").type),
                                              pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(sets, arrow.field("langs").type),
                                              pa.array(shares, arrow.field("shares").type)], schema=arrow)

    out = docs.mapInArrow(run, schema)
    return out if carry else out.drop("row")
