"""Registered queries over the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.llm import oracle
from adlift.llm.adaptive_scan import nearest
from adlift.llm.common import WORD, shared_dir, written
from adlift.llm.embedding_dedup import embedding_groups
from adlift.llm.html_text import extract_text
from adlift.llm.language_id import learn, predict_language
from adlift.llm.line_dedup import drop_repeated_lines
from adlift.llm.minhash_dedup import minhash_groups
from adlift.llm.mixing import mix_sources
from adlift.llm.period_runs import periodic_runs
from adlift.llm.quality_rules import quality_rules
from adlift.llm.recurrent_lm import score_documents
from adlift.llm.sentencepiece_lattice import encode, load_model
from adlift.llm.token_counts import Ledger, count_tokens, token_count
from adlift.llm.whitening import whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(_documents(spark, sf_dir), words=4, percent=80)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_documents(spark, sf_dir), load_model(PIECES), order="merge")


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    return score_documents(_documents(spark, sf_dir), learn)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Production targets of the mixture; categories without one share the rest in proportion to their tokens.
TARGETS = {"source": {"src0": 0.25}, "lang": {"en": 0.57, "fr": 0.16, "de": 0.16, "es": 0.11}, "topic": {"prose": 0.95}}
#: Share of all tokens that the mixture keeps.
BUDGET = 0.75


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_documents(spark, sf_dir), TARGETS, budget=BUDGET)
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, delete the documents labelled bad, revise the toxic ones to words of two characters or more, move to a
    second tokenizer version; the first two batches are committed again, which changes nothing."""
    docs = _documents(spark, sf_dir)
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # texts are counted where they are read; only ids and counts meet the labels
    longer = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]{2,}")), F.lit(0)).cast("long")
    counts = count_tokens(docs.withColumns({"longer": longer, "pieces": token_count("pieces-2", "text")}), keep=("longer", "pieces"))
    counts = written(counts.join(marks, "doc_id", "left"), "counted")
    bad, none = F.coalesce(F.col("quality") == 0, F.lit(False)), F.lit(0).cast("long")
    first = counts.withColumn("old_tokens", none)
    revised = counts.where((F.col("toxic") == 1) & ~bad).withColumn("old_tokens", F.col("n_tokens"))
    pieces = first.where(~bad).withColumns({"tokenizer": F.lit("pieces-2"), "n_tokens": F.col("pieces")})
    batches = {
        "load": first.withColumn("kind", F.lit("insert")),
        "purge": first.where(bad).withColumn("kind", F.lit("delete")),
        "revise": revised.withColumns({"kind": F.lit("revise"), "n_tokens": F.col("longer")}),
        "pieces": pieces.withColumn("kind", F.lit("insert")),
    }
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    for batch in [*batches, "load", "purge"]:
        ledger.commit(batch, batches[batch])
    return ledger.totals(list(batches))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    # a null id has no crc32: it is not held out, and learnt from
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False))
    out = predict_language(docs, learn(docs.where(~held)))
    return out.withColumn("held_out", held)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where the exact sum (``deviation_exact``) does not fit a long."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16, scale=64.0)
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened",
                      "explained", "identity_error", F.col("deviation").alias("deviation_exact"))


def op12_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def wrapped(docs: DataFrame) -> DataFrame:
    """Documents whose crc32(doc_id as text) is divisible by 10 and that have n words: from word a on, the first p words from
    there again and again. A null id has no crc32 and its text stays."""
    words, h = F.col("_words"), F.col("_h")
    g = F.floor(h / 10)
    a = F.pmod(g, F.size(words)).cast("int")
    p = (1 + F.floor((F.size(words) - a) / (3 + g % 8))).cast("int")
    word = F.transform(words, lambda w, i: F.when(i < F.col("_a"), w).otherwise(words[F.col("_a") + (i - F.col("_a")) % F.col("_p")]))
    marked = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    some = (h % 10 == 0) & F.regexp_like("text", F.lit(WORD))
    marked = marked.withColumn("_words", F.when(some, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))
    marked = marked.withColumns({"_a": F.when(F.col("_words").isNotNull(), a), "_p": F.when(F.col("_words").isNotNull(), p)})
    return marked.select("doc_id", F.when(words.isNotNull(), F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(wrapped(_documents(spark, sf_dir)), least=12)
    best = F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    out = out.withColumn("best", F.get(best, F.lit(0)))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_recurrent_lm": op3_recurrent_lm,
        "op4_quality_rules": op4_quality_rules,
        "op5_line_dedup": op5_line_dedup,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_html_text": op7_html_text,
        "op8_source_mix": op8_source_mix,
        "op9_token_counts": op9_token_counts,
        "op10_language_id": op10_language_id,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_adaptive_scan": op12_adaptive_scan,
        "op13_period_runs": op13_period_runs,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": oracle.LINE_DEDUP,
        "op8_source_mix": oracle.source_mix(TARGETS, BUDGET),
        "op9_token_counts": oracle.TOKEN_COUNTS,
    }
