"""Token counts as delta-maintained rollups.

A ledger folder holds one Parquet folder a committed batch, named by the batch
id, with the batch's signed totals by source, language and tokenizer version.
Inserts add a document's count, deletes subtract it, revisions subtract the old
and add the new count. Totals are the sum over batches: additive, so a batch
touches nothing but its own rows. Committing a batch id again changes nothing;
a batch half written by a lost job has no success mark and is written anew.
Every step is a grouped sum with partial sums before the shuffle, so a hot
source is a few rows a task.

Defined results: null source, language or version is the empty name; null
counts are 0; a change without a known kind raises no row. Repeated change rows
count as often as they occur. An empty batch commits and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlift.llm.common import WORD

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def token_count(version: str, text_col: str) -> Column:
    """Tokens of a text under a tokenizer version, 0 for null.

    ``words-1``: runs of non-space characters. ``pieces-2``: runs of at most
    four characters of such words, the larger count that a later tokenizer gives.
    """
    pattern = {"words-1": WORD, "pieces-2": r"[^\x20\x09-\x0D]{1,4}"}[version]
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(pattern)), F.lit(0)).cast("long")


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 lang_col: str = "lang", version: str = "words-1", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of every row under a tokenizer version, and the columns ``keep``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.col(lang_col).cast("string").alias("lang"), F.lit(version).alias("tokenizer"),
                       token_count(version, text_col).alias("n_tokens"), *keep)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed totals of changes: kind (insert, delete, revise), source, lang, tokenizer, n_tokens, old_tokens."""
    name = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in KEYS]
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.expr("case kind when 'insert' then 1 when 'delete' then -1 else 0 end")
    tokens = F.when(F.col("kind") == "insert", new).when(F.col("kind") == "delete", -new).otherwise(new - old)
    signed = changes.where("kind in ('insert', 'delete', 'revise')").select(
        *name, docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))
    return signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Ledger:
    """Committed batches under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write a batch's totals once; False where the batch is committed already."""
        path = f"{self.path}/batch={batch}"
        if self._exists(f"{path}/_SUCCESS"):
            return False
        deltas(changes).write.mode("overwrite").parquet(path)
        return True

    def totals(self, batches: list[str]) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens summed over the named batches; rows of zero documents and tokens are gone."""
        paths = [f"{self.path}/batch={b}" for b in batches if self._exists(f"{self.path}/batch={b}/_SUCCESS")]
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        total = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return total.where("n_docs <> 0 or n_tokens <> 0")
