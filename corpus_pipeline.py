"""Corpus preparation: five stages over ``documents``, each written and read again as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.llm.common import WORD, written
from adlift.llm.language_id import learn, predict_language
from adlift.llm.line_dedup import drop_repeated_lines
from adlift.llm.minhash_dedup import minhash_groups, text_digest
from adlift.llm.mixing import mix_sources
from adlift.llm.queries import BUDGET, PIECES, TARGETS
from adlift.llm.sentencepiece_lattice import encode, load_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose main language has a smaller share of its words is rejected.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without a main one, go. Where no row has both a text and a language, nothing
    can be learned, and every document with a letter stays."""
    model = learn(docs)
    if not model[0]:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}"))).select(*COLUMNS)
    out = predict_language(docs, model, carry=True)
    return out.where(f"lang_pred <> 'und' and score >= {LEAST_SHARE}").select(*[F.col(f"row.{c}") for c in COLUMNS])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that have no text left; n_chars follows the text."""
    out = drop_repeated_lines(docs, carry=True)
    kept = out.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return kept.select("doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, then the smallest digest of its
    text; null ids come last. Documents without words have no copies and stay."""
    groups = minhash_groups(docs, words=5, percent=80, by_text=True).where("root is not null")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "digest")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("first_id"), F.col("x.digest").alias("first_digest"))
    words = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    texts = docs.where(words).withColumn("digest", text_digest(F.col("text")))
    same = texts.doc_id.eqNullSafe(first.first_id) & (texts.digest == first.first_digest)
    kept = texts.join(first, same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return kept.select(*COLUMNS).unionByName(docs.where(~words).select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target marginals, as far as the token budget allows."""
    return mix_sources(docs, TARGETS, budget=BUDGET, carry=True).where("kept").select(*[F.col(f"row.{c}") for c in COLUMNS])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, exact."""
    return encode(docs, load_model(PIECES), order="merge")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup),
          ("source_mix", source_mix), ("sentencepiece", sentencepiece)]

#: SQL cannot express the language mixture, near-duplicate groups by shingle sets at scale, or the lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
