"""Nearest neighbours by inner product with an adaptive dimension scan.

Index. Equal vectors are one class that keeps its ``k`` + 1 smallest ids, more
of which no answer can need. Directions are dealt to lists by the nearest of
about sqrt(n) centres (spherical k-means on a bounded sample, ``SAMPLE`` rows);
every class is in one list. How many lists a query probes is set on the same
sample: the least number at which ``TARGET`` of the true neighbours among the
sample lie in the probed lists. On data without clusters that is a large part
of all lists, on clustered data a small one. Neighbouring lists share a shard
of at most ``SHARD`` classes (``SHARD_BYTES`` of vectors), a longer list is dealt to several; a query goes
once to each shard that it probes.

Scan. Within a shard unit vectors are turned by one random rotation and read in
column blocks. A candidate of norm |x| can beat the k-th best score t of unit
query only if its squared distance is at most r^2 = 2 - 2 t / |x|. After d of D
rotated dimensions its partial distance over r^2 is Beta(d/2, (D-d)/2), were
the distance r; a candidate whose partial distance exceeds the 1 - ``RISK``
quantile is abandoned. Blocks are read for all candidates while many are left,
then for those left only. What is never abandoned is scored by the inner
product of the original vectors, added up in order of the dimensions.

Queries of equal vectors are searched once, for k + 1 neighbours; each takes
its own id out.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part. Vectors are compared with those of their length only.
Rows repeating an id and its vector count once; a row with the query's id is
never its answer. A null id is no query, and as an answer comes after all ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlift.llm.common import small_batches, written
from adlift.llm.vectors import digest, matrices, stacked

SAMPLE = 16_384
PROBES = 512        # sample rows that serve as queries when the probes are set
TARGET = 0.97
LISTS = 4096
SHARD = 8192
SHARD_BYTES = 32 << 20
QUERIES = 4096      # queries of a shard compared in one task
COLUMNS = 16
RISK = 0.001


def _units(x: np.ndarray) -> np.ndarray:
    y = x / np.abs(x).max(axis=1)[:, None]      # squares of large entries would overflow
    return y / np.linalg.norm(y, axis=1)[:, None]


def _nearest(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(units[i:i + 4096] @ centres.T, axis=1) for i in range(0, len(units), 4096)])


def _centres(units: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; a centre without rows stays where it is. Ordered so that neighbours are near."""
    centres = units[rng.choice(len(units), size=lists, replace=False)]
    for _ in range(8):
        own = _nearest(units, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        norm = np.linalg.norm(sums, axis=1)[:, None]
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), centres)
    left, order = list(range(1, lists)), [0]
    while left:
        near = int(np.argmax(centres[left] @ centres[order[-1]]))
        order.append(left.pop(near))
    return centres[order]


def _probes(x: np.ndarray, units: np.ndarray, centres: np.ndarray, k: int) -> int:
    """Least number of lists that hold TARGET of the k best of every probed sample row, among the sample."""
    own = _nearest(units, centres)
    found = []
    for i in range(0, min(PROBES, len(x)), 64):
        at = np.arange(i, min(i + 64, PROBES, len(x)))
        score = units[at] @ x.T
        score[np.arange(len(at)), at] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
        rank = np.argsort(np.argsort(-(units[at] @ centres.T), axis=1, kind="stable"), axis=1)
        found.append(np.take_along_axis(rank, own[best], axis=1).ravel())
    ranks = np.sort(np.concatenate(found))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def beta_quantile(a: float, b: float, p: float) -> float:
    """Quantile of the Beta distribution from its density on a fine grid."""
    at = (np.arange(200_000) + 0.5) / 200_000
    log = (a - 1) * np.log(at) + (b - 1) * np.log1p(-at)
    mass = np.cumsum(np.exp(log - log.max()))
    return float(at[min(len(at) - 1, np.searchsorted(mass, p * mass[-1]))])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in order of the dimensions."""
    return np.add.accumulate(q * x, axis=1)[:, -1]


def _best(query: np.ndarray, item: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best items of every query: by score, ties to the smaller first id."""
    order = np.lexsort((first[item], -score, query))
    query, item, score = query[order], item[order], score[order]
    begin = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    keep = rank < k
    return query[keep], item[keep], score[keep]


class Scan:
    """The adaptive scan of one length of vector; holds the rotation and the quantiles of the tests."""

    def __init__(self, dims: int, k: int):
        rng = np.random.default_rng(11)
        self.turn, self.k = np.linalg.qr(rng.normal(size=(dims, dims)))[0], k
        self.cuts = list(range(0, dims, COLUMNS)) + [dims]
        self.limit = [beta_quantile(d / 2, (dims - d) / 2, 1 - RISK) for d in self.cuts[1:-1]]

    def run(self, queries: np.ndarray, probed: list[np.ndarray], items: np.ndarray, lists: np.ndarray,
            first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, item, score) of the k best found; probed[i] are the rows of ``queries`` that probe list i."""
        q, x = _units(queries) @ self.turn, _units(items) @ self.turn
        norm = np.linalg.norm(items / np.abs(items).max(axis=1)[:, None], axis=1) * np.abs(items).max(axis=1)
        empty = np.empty(0, dtype=np.int64)
        best = (empty, empty, np.empty(0))
        kth = np.full(len(q), -np.inf)      # k-th best score so far, for the unit query
        size = np.linalg.norm(queries / np.abs(queries).max(axis=1)[:, None], axis=1) * np.abs(queries).max(axis=1)
        for i, asking in enumerate(probed):
            own = np.flatnonzero(lists == i)
            for at in range(0, len(asking) if len(own) else 0, 256):
                rows = asking[at:at + 256]
                a, b = self._survivors(q, x, norm, rows, own, kth)
                score = np.concatenate([_scores(queries[a[j:j + 65536]], items[b[j:j + 65536]]) for j in range(0, len(a), 65536)]
                                       or [np.empty(0)])
                mine = np.isin(best[0], rows)
                merged = _best(np.concatenate((best[0][mine], a)), np.concatenate((best[1][mine], b)),
                               np.concatenate((best[2][mine], score)), first, self.k)
                best = tuple(np.concatenate((old[~mine], new)) for old, new in zip(best, merged, strict=True))
                count = np.bincount(merged[0], minlength=len(q))
                low = np.full(len(q), np.inf)
                np.minimum.at(low, merged[0], merged[2])
                full = np.flatnonzero(count >= self.k)
                kth[full] = low[full] / size[full]
        return best

    def _survivors(self, q: np.ndarray, x: np.ndarray, norm: np.ndarray, rows: np.ndarray, own: np.ndarray,
                   kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, item) that no test abandons."""
        threshold = kth[rows].copy()
        part = np.zeros((len(rows), len(own)))
        a = b = held = radius = None
        for block, limit in enumerate([*self.limit, 1.0]):
            columns = slice(self.cuts[block], self.cuts[block + 1])
            if a is None:
                part += self._distances(q[rows], x[own], columns)
                # the k best by the blocks read so far are completed: the k-th of them can only raise the threshold
                if len(own) >= self.k:
                    guess = norm[own] * (1 - part * (len(self.turn) / self.cuts[block + 1] / 2))
                    top = np.argpartition(-guess, self.k - 1, axis=1)[:, :self.k]
                    full = norm[own[top]] * np.einsum("ij,ikj->ik", q[rows], x[own[top]])
                    threshold = np.maximum(threshold, full.min(axis=1) - 1e-9 * np.abs(full).max(axis=1))
                radius = np.where(np.isfinite(threshold)[:, None], 2 - 2 * threshold[:, None] / norm[own][None] + 1e-9, np.inf)
                keep = part <= limit * radius
                if keep.mean() < 0.1 or block == len(self.limit):
                    a, b = np.nonzero(keep)
                    held, radius = part[a, b], radius[a, b]
                else:
                    part[~keep] = np.inf
            else:
                held = held + ((q[rows[a], columns] - x[own[b], columns]) ** 2).sum(axis=1)
                keep = held <= limit * radius
                a, b, held, radius = a[keep], b[keep], held[keep], radius[keep]
        return rows[a], own[b]

    @staticmethod
    def _distances(q: np.ndarray, x: np.ndarray, columns: slice) -> np.ndarray:
        q, x = q[:, columns], x[:, columns]
        return np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * (q @ x.T), 0.0)


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by inner product. ``is_query`` is a
    condition on a column ``vec_id``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                some = x.any(axis=1)
                raw = [v.tobytes() for v in x[some]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[some])), pa.array([digest(v) for v in raw], pa.binary()),
                                                  pa.array(raw, pa.binary())], names=["vec_id", "node", "vec"])

    rows = written(rows.mapInArrow(make, "vec_id long, node binary, vec binary").groupBy("node", "vec_id").agg(F.first("vec").alias("vec")), "rows")
    asked = F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last()))
    some_ids = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda s: s["vec_id"])
    asking = rows.where(asked).select("node").distinct().withColumn("asks", F.lit(True))
    classes = some_ids.groupBy("node").agg(F.first("vec").alias("vec"), ids.alias("ids")).join(asking, "node", "left")
    classes = written(classes, "classes")

    # a sample by hash: bounded whatever the table's size
    count = classes.count()
    share = int(min(1.0, SAMPLE / max(1, count)) * (1 << 30))
    sample: dict[int, list[bytes]] = {}
    for r in classes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share).select("vec").collect():
        sample.setdefault(len(r.vec) // 8, []).append(bytes(r.vec))
    rng, index = np.random.default_rng(5), {}
    for dims, raw in sample.items():
        x = stacked(sorted(raw))
        units = _units(x)
        lists = max(1, min(LISTS, len(x) // 4, int(np.sqrt(count))))
        centres = _centres(units, lists, rng)
        index[dims] = (centres, _probes(x, units, centres, k))
    shared = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.array([len(v) // 8 for v in batch.column("vec").to_pylist()])
            for dims in np.unique(length):
                part = batch.filter(pa.array(length == dims))
                units = _units(stacked(part.column("vec").to_pylist()))
                # a length that the sample does not have is one list
                centres, probes = shared.value.get(int(dims), (units[:1] * 0, 1))
                own, asks = _nearest(units, centres), np.array([v is True for v in part.column("asks").to_pylist()])
                asked_lists = [None] * len(units)
                for i in np.flatnonzero(asks):
                    near = np.argpartition(-(centres @ units[i]), probes - 1)[:probes] if probes < len(centres) else np.arange(len(centres))
                    asked_lists[i] = np.sort(near).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("vec"), part.column("ids"), pa.array(np.full(len(units), dims, dtype=np.int32)),
                     pa.array(own.astype(np.int32)), pa.array(asked_lists, pa.list_(pa.int32()))],
                    names=["node", "vec", "ids", "dims", "list", "probes"])

    dealt = classes.mapInArrow(deal, "node binary, vec binary, ids array<long>, dims int, list int, probes array<int>")
    dealt = written(dealt, "dealt")

    # shards: neighbouring lists together up to SHARD classes; at most LISTS rows a length of vector
    sizes = dealt.groupBy("dims", "list").agg(F.count("*").alias("m"))
    filled = F.sum("m").over(Window.partitionBy("dims").orderBy("list"))
    room = F.greatest(F.lit(256), F.least(F.lit(SHARD), F.lit(SHARD_BYTES) / (8 * F.col("dims"))))
    shards = sizes.select("dims", "list", F.floor((filled - 1) / room).cast("int").alias("shard"),
                          F.ceil(F.col("m") / room).cast("int").alias("parts"))
    shards = written(shards, "shards")
    part = F.pmod(F.hash("node"), F.col("parts")).cast("int")
    items = dealt.join(F.broadcast(shards), ["dims", "list"]).select(
        "dims", "shard", part.alias("part"), "list", "node", "vec", "ids")
    widest = shards.groupBy("dims", "shard").agg(F.max("parts").alias("parts"))
    probes = dealt.where("probes is not null").select("dims", "node", "vec", F.explode("probes").alias("list")).join(
        F.broadcast(shards.select("dims", "list", "shard")), ["dims", "list"])
    probes = probes.groupBy("dims", "shard", "node").agg(F.first("vec").alias("vec"), F.collect_list("list").alias("lists"))
    asked_sizes = probes.groupBy("dims", "shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    plan = widest.join(asked_sizes, ["dims", "shard"])
    key = ["dims", "shard", "part", "block"]
    none = F.lit(None)
    left = items.join(F.broadcast(plan.drop("parts")), ["dims", "shard"]).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, "node", "vec", "ids", F.col("list"), none.cast("array<int>").alias("lists"))
    right = probes.join(F.broadcast(plan), ["dims", "shard"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.pmod(F.hash("node"), F.col("blocks")).cast("int"))
    right = right.select(*key, "node", "vec", none.cast("array<long>").alias("ids"), none.cast("int").alias("list"), "lists")
    schema = pa.schema([("node", pa.binary()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def compare(table: pa.Table) -> pa.Table:
        dims, lists = table.column("dims")[0].as_py(), table.column("lists").to_pylist()
        asks = np.array([v is not None for v in lists])
        vec, node = table.column("vec").to_pylist(), table.column("node").to_pylist()
        q_at, x_at = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q_at) or not len(x_at):
            return schema.empty_table()
        own = np.array([v for v in table.column("list").to_pylist() if v is not None])
        names, own = np.unique(own, return_inverse=True)
        ids = [v for v in table.column("ids").to_pylist() if v is not None]
        first = np.array([np.iinfo(np.int64).max if v[0] is None else v[0] for v in ids])
        asking: dict[int, list[int]] = {}
        for i, at in enumerate(q_at):
            for name in lists[at]:
                asking.setdefault(name, []).append(i)
        probed = [np.array(asking.get(int(n), []), dtype=np.int64) for n in names]
        scan = Scan(dims, k + 1)
        query, item, score = scan.run(stacked([vec[i] for i in q_at]), probed, stacked([vec[i] for i in x_at]), own, first)
        return pa.table([pa.array([node[q_at[i]] for i in query], pa.binary()), pa.array(score), pa.array([ids[i] for i in item], schema.field("ids").type)],
                        schema=schema)

    found = left.unionByName(right).groupBy(*key).applyInArrow(compare, "node binary, score double, ids array<long>")
    order = Window.partitionBy("node").orderBy(F.desc("score"), F.col("ids")[0].asc_nulls_last())
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    found = written(found, "found")
    hits = found.select("node", "score", F.explode("ids").alias("vec_id")).select(
        "node", F.struct((-F.col("score")).alias("far"), F.col("vec_id").isNull().alias("late"), "vec_id", "score").alias("hit"))
    hits = hits.groupBy("node").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    queries = rows.where(asked).select(F.col("vec_id").alias("query_id"), "node").join(hits, "node")
    others = F.slice(F.filter("hits", lambda h: ~h["vec_id"].eqNullSafe(F.col("query_id"))), 1, k)
    out = queries.select("query_id", F.posexplode(others).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
