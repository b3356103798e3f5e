"""Repeated-line removal with two Bloom filters.

Scan one sets, for every line key, bits in a once-seen filter, and in a
twice-seen filter where another document of the task held the key. The tasks'
filters are merged in groups of bounded size: a bit seen once by two tasks is
seen twice. Only keys whose bits are all set in the merged twice-seen filter
shuffle in scan two; an exact grouping confirms them and finds the smallest
document. A filter has no false negatives, so the result is exact at any filter
size; a fuller filter only shuffles more keys. The filters take 16 bits a line
up to ``max_bits`` (default 32 MB each), which bounds what is broadcast.

Defined results: a null or empty text is one empty line. Documents are told
apart by id; rows that repeat an id are one document and get the same decision
each. A null id is the last document. Other columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from adlift.llm.common import small_batches, written

HASHES = 3
BLOCK = 1 << 12          # bytes of a filter block
FAN_IN = 64              # blocks merged at a time
EDGE = b" \t\n\v\f\r"
LAST = (1 << 63) - 1     # stands for a null id


def line_keys(text: bytes, least: int) -> list[bytes | None]:
    """Per line: its key, or None where the key has fewer than ``least`` code points."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(EDGE).lower()
        long = len(key) >= least and (key.isascii() or len(key.decode()) >= least)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """(n, HASHES) bit numbers by double hashing of the two halves of a key's digest."""
    h = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    step = np.arange(HASHES, dtype=np.uint64)
    return ((h[:, :1] + step * (h[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def _fill(bits: int, least: int):
    schema = pa.schema([("task", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        once, twice = np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                keys = list({k for k in line_keys(text or b"", least) if k})
                if keys:
                    at = _places(keys, bits)
                    twice[at[once[at].all(axis=1)]] = True
                    once[at] = True
        once, twice = (np.packbits(x).reshape(-1, min(BLOCK, bits // 8)) for x in (once, twice))
        task = TaskContext.get().partitionId()
        full = np.flatnonzero(once.any(axis=1))
        for i in range(0, len(full), 256):
            part = full[i:i + 256]
            yield pa.RecordBatch.from_arrays([
                pa.array([task] * len(part), pa.int32()), pa.array(part, pa.int32()),
                pa.array([once[b].tobytes() for b in part]), pa.array([twice[b].tobytes() for b in part])], schema=schema)
    return run


def _merge(table: pa.Table) -> pa.Table:
    once = twice = None
    for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pa.table({"task": table.column("task")[:1], "block": table.column("block")[:1],
                     "once": pa.array([once.tobytes()]), "twice": pa.array([twice.tobytes()])})


def _filters(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """The merged twice-seen filter, ``bits`` / 8 bytes."""
    schema = "task int, block int, once binary, twice binary"
    tasks, parts = texts.rdd.getNumPartitions(), texts.mapInArrow(_fill(bits, least), schema)
    while True:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
        parts = parts.groupBy("task", "block").applyInArrow(_merge, schema)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    out = np.zeros((max(1, bits // 8 // BLOCK), min(BLOCK, bits // 8)), dtype=np.uint8)
    for row in written(parts.select("block", "twice"), "filter").collect():   # bounded by max_bits
        out[row.block] = np.frombuffer(row.twice, np.uint8)
    return out.ravel()


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10,
                        max_bits: int = 1 << 28, carry: bool = False) -> DataFrame:
    """Lines whose key occurs in several documents stay only in the smallest document that holds it.

    A key is the line without white space at its ends, A-Z lower-cased, of at
    least ``least`` code points. Returns doc_id, text (kept lines joined by
    newlines), n_lines (before), n_dropped; with ``carry`` also ``row``, a struct of the other input columns.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rest = [F.col(c) for c in docs.columns if c != text_col] if carry else [F.lit(None).cast("int").alias("none")]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").cast("binary").alias("text"), F.struct(*rest).alias("row"))
    newlines = F.octet_length("text") - F.octet_length(F.translate(F.col("text").cast("string"), "\n", ""))
    lines = docs.agg(F.sum(F.coalesce(newlines, F.lit(0)) + 1)).first()[0] or 0
    bits = min(max_bits, 1 << max(16, (16 * lines - 1).bit_length()))
    twice = spark.sparkContext.broadcast(_filters(docs.select("text"), bits, least))

    schema = docs.select("doc_id", "text", "row", F.lit(0).alias("n_lines"),
                         F.array(F.lit(b"")).alias("suspects")).schema
    arrow = to_arrow_schema(schema)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = twice.value
        for batch in batches:
            count, suspects = [], []
            for text in batch.column("text").to_pylist():
                keys = line_keys(text or b"", least)
                count.append(len(keys))
                keys = list({k for k in keys if k})
                if keys:
                    at = _places(keys, bits)
                    hit = ((seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
                    keys = [keys[i] for i in np.flatnonzero(hit)]
                suspects.append(keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2).cast(arrow.field("row").type),
                 pa.array(count, pa.int32()), pa.array(suspects, arrow.field("suspects").type)], schema=arrow)

    probed = written(docs.mapInArrow(probe, schema), "probed")
    number = F.coalesce("doc_id", F.lit(LAST))
    found = probed.select(number.alias("d"), F.explode("suspects").alias("key"))
    repeated = found.groupBy("key").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    drops = (found.join(repeated.select("key", "first"), "key").where("d > first")
             .groupBy("d").agg(F.collect_set("key").alias("gone")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                text = text or b""
                if gone:
                    gone, parts = set(gone), text.split(b"\n")
                    parts = [p for p, k in zip(parts, line_keys(text, least), strict=True) if k not in gone]
                    dropped.append(text.count(b"\n") + 1 - len(parts))
                    text = b"\n".join(parts)
                else:
                    dropped.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary()), batch.column("row").cast(done.field("row").type),
                 batch.column("n_lines"), pa.array(dropped, pa.int32())], schema=done)

    after = probed.select("doc_id", "text", "row", "n_lines", F.lit(0).alias("n_dropped")).schema
    done = to_arrow_schema(after)
    some = probed.where(F.size("suspects") > 0)
    some = some.withColumn("d", F.coalesce("doc_id", F.lit(LAST))).join(drops, "d", "left")
    changed = some.select("doc_id", "text", "row", "n_lines", "gone").mapInArrow(apply, after)
    same = probed.where(F.size("suspects") == 0).select("doc_id", F.coalesce("text", F.lit(b"")).alias("text"),
                                                         "row", "n_lines", F.lit(0).alias("n_dropped"))
    out = same.union(changed)
    return out.select("doc_id", F.col("text").cast("string").alias("text"), F.col("n_lines").cast("long").alias("n_lines"),
                      F.col("n_dropped").cast("long").alias("n_dropped"), *([F.col("row")] if carry else []))
