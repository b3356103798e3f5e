"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space of the word rule [^\x20\x09-\x0D]+; bytes.split() uses the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``; a private one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest(df: DataFrame, order: str, k: int) -> DataFrame:
    """The ``k`` rows of a written ``df`` with the smallest ``order``, 16 evenly spread bytes. Rows above a threshold taken
    from the count are left out first, so that tasks send about 2 k rows to the driver in all, not k each; where the
    bytes are so uneven that fewer than k rows stay, the threshold is left out."""
    count = df.count()
    if count > 2 * k:
        share = int((1 << 64) * (2 * k / count))
        low = df.where(F.col(order) < F.lit(share.to_bytes(8, "big")))
        if low.count() >= k:
            df = low
    return df.orderBy(order).limit(k)


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Per Arrow batch: ``make()`` once per task, then its function on a dict of Python lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of each."""
    have = _TABLES.get("pow")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _TABLES[name] = np.multiply.accumulate(step)
    if "byte" not in _TABLES:
        _TABLES["byte"] = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * 2 + 1
    return _TABLES["pow"], _TABLES["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each white-space separated word of ``data``, in order, without making the words."""
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return np.empty(0, dtype=np.uint64)
    gap = np.concatenate(([True], _SPACE[a], [True]))
    start = np.flatnonzero(gap[:-1] & ~gap[1:])
    end = np.flatnonzero(~gap[:-1] & gap[1:])
    power, inverse = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_TABLES["byte"][a] * power[:len(a)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; shorter sequences are one shingle, none is empty."""
    n = len(words)
    if not n:
        return words
    size = min(n, size)
    acc = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        acc = mix(acc + words[i:n - size + 1 + i]) * np.uint64(_BASE)
    return np.unique(acc)


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps; every step is a grouped minimum
    (combined before the shuffle) and a join, so a node with many links is no hot
    group. Each round is written to the shared folder.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = written(edges, name), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
