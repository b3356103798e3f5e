"""Embedding whitening from bit-sliced cross-products.

Entries become integers x = floor(scale * c) + OFFSET. The fit list is every
distinct x vector once. A task takes blocks of it, lowers each dimension to
start at 0, and packs every bit plane of every dimension across the rows of a
block into 64-bit words. The popcount of two planes ANDed, weighted by both
planes' powers of two, is a term of an exact cross-product. Sums and products
of the blocks become Python integers free of any shift, leave a task as six
limbs of 32 bits, and are added by a grouped sum of longs, so no total depends
on partitions or overflows. The centred n * sum(x_j x_k) - S_j S_k is an
integer too; only then it is divided and goes to ``eigh``, on the driver, with
as many numbers as the dimensions squared.

Vectors of another length are whitened by a fit of their own.

Defined results: vectors that are null or empty or hold null or non-finite
entries are dropped. Rows repeating an id, and null ids, are rows of their own.
Scaled entries beyond 2**62 count as 2**62. A component without variance (its
eigenvalue at most 1e-12 of the trace) has a null ``whitened`` and no part in
``identity_error``; where the trace is 0 ``explained`` is null. ``deviation``
of an operator's row is decimal(38, 0), and null where it has more digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlift.llm.common import small_batches, written
from adlift.llm.vectors import matrices

OFFSET = 1_000_000
BLOCK = 1 << 16     # rows whose bit planes are held at once
LIMBS = 6


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) + OFFSET as longs."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -2.0 ** 62, 2.0 ** 62).astype(np.int64) + OFFSET


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of longs as bytes: the width of an entry, then each less OFFSET in that width, the narrowest it fits."""
    near = x - OFFSET
    span = np.maximum(near.max(axis=1), -(near.min(axis=1) + 1))
    out: list[bytes] = [b""] * len(x)
    done = np.zeros(len(x), dtype=bool)
    for width in (1, 2, 4, 8):
        rows = np.flatnonzero(~done & (span < 1 << (8 * width - 1)))
        done[rows] = True
        small = near[rows].astype(f"<i{width}")
        for i, row in zip(rows.tolist(), small, strict=True):
            out[i] = bytes([width]) + row.tobytes()
    return out


def unpack(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, longs) for each length of vector."""
    width, size = np.array([v[0] for v in raw]), np.array([len(v) - 1 for v in raw])
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for w, s in sorted(set(zip(width.tolist(), size.tolist(), strict=True))):
        rows = np.flatnonzero((width == w) & (size == s))
        x = np.frombuffer(b"".join(raw[i][1:] for i in rows), dtype=f"<i{w}").reshape(len(rows), -1)
        parts.setdefault(s // w, []).append((rows, x.astype(np.int64) + OFFSET))
    for found in parts.values():
        yield np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (d) and cross-products (d, d) of longs, as Python integers, by popcounts of ANDed bit planes."""
    rows, dims = x.shape
    low = x.min(axis=0)
    lowered = x.astype(np.uint64) - low.astype(np.uint64)
    planes, dim, weight = [], [], []
    for bit in range(int(lowered.max()).bit_length()):
        words = np.packbits((lowered >> np.uint64(bit)).astype(np.uint8) & 1, axis=0).T
        words = np.pad(words, ((0, 0), (0, -words.shape[1] % 8))).copy().view(np.uint64)
        some = words.any(axis=1)
        planes.append(words[some])
        dim += np.flatnonzero(some).tolist()
        weight += [bit] * int(some.sum())
    sums = np.zeros(dims, dtype=object)
    products = np.zeros((dims, dims), dtype=object)
    if planes and len(dim):
        order = np.argsort(dim, kind="stable")
        planes, dim, weight = np.concatenate(planes)[order], np.array(dim)[order], np.array(weight)[order]
        counts = np.zeros((len(planes), len(planes)), dtype=np.int64)
        for a in range(len(planes)):
            counts[a, a:] = np.bitwise_count(planes[a:] & planes[a]).sum(axis=1, dtype=np.int64)
        counts += np.triu(counts, 1).T
        # products of two weights times a count stay below 2**63, or Python integers take over
        kind = np.int64 if 2 * (int(weight.max()) + 1) + int(rows).bit_length() < 62 else object
        power = np.array([1 << int(w) for w in weight], dtype=kind)
        begin = np.flatnonzero(np.concatenate(([True], dim[1:] != dim[:-1])))
        used = dim[begin]
        weighted = counts.astype(kind) * power[:, None] * power[None, :]
        products[np.ix_(used, used)] = np.add.reduceat(np.add.reduceat(weighted, begin, axis=0), begin, axis=1).astype(object)
        sums[used] = np.add.reduceat(np.diag(counts).astype(kind) * power, begin).astype(object)
    low = low.astype(object)
    raised = products + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)
    return sums + rows * low, raised


def _limbs(value: int) -> list[int]:
    return [(value >> 32 * i) & 0xFFFFFFFF for i in range(LIMBS - 1)] + [value >> 32 * (LIMBS - 1)]


_TOTALS = "dims int, j int, k int, " + ", ".join(f"l{i} long" for i in range(LIMBS))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (j, k) of the cross-products, (j, -1) of the sums and (-1, -1) of the count, one set a task and length."""
    held: dict[int, list[np.ndarray]] = {}
    total: dict[int, list] = {}

    def close(dims: int) -> None:
        block = np.concatenate(held.pop(dims))
        for at in range(0, len(block), BLOCK):
            part = block[at:at + BLOCK]
            sums, products = cross_products(part)
            have = total.setdefault(dims, [0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)])
            have[0] += len(part)
            have[1] += sums
            have[2] += products

    for batch in batches:
        for _, x in unpack(batch.column(0).to_pylist()) if batch.num_rows else []:
            dims = x.shape[1]
            held.setdefault(dims, []).append(x)
            if sum(map(len, held[dims])) >= BLOCK:
                close(dims)
    for dims in list(held):
        close(dims)
    for dims, (count, sums, products) in total.items():
        cells = [(-1, -1, count)] + [(j, -1, sums[j]) for j in range(dims)]
        cells += [(j, k, products[j, k]) for j in range(dims) for k in range(j, dims)]
        limbs = zip(*[_limbs(int(v)) for _, _, v in cells], strict=True)
        columns = [pa.array([dims] * len(cells), pa.int32()), pa.array([c[0] for c in cells], pa.int32()),
                   pa.array([c[1] for c in cells], pa.int32()), *[pa.array(v, pa.int64()) for v in limbs]]
        yield pa.RecordBatch.from_arrays(columns, names=["dims", "j", "k", *[f"l{i}" for i in range(LIMBS)]])


@dataclass
class Whitener:
    """The fit of one length of vector: the count, the exact sums and the leading components."""

    n: int
    sums: list[int]
    vectors: np.ndarray         # (dims, components)
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they fit, else Python integers."""
        mean = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n for s in self.sums])
        near = x - mean
        if int(np.abs(near).max(initial=0)) + 1 < 2 ** 62 // self.n:
            return near * self.n - rest
        return near.astype(object) * self.n - rest.astype(object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN for components without variance."""
        some = self.values > 1e-12 * self.trace
        scale = np.where(some, np.sqrt(np.where(some, self.values, 1.0)), np.nan)
        return (centred.astype(np.float64) / self.n) @ self.vectors / scale

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]


def _solve(n: int, sums: list[int], products: list[list[int]], components: int) -> Whitener:
    dims = len(sums)
    # a quotient of Python integers is rounded once
    cov = np.array([[(n * products[j][k] - sums[j] * sums[k]) / (n * n) for k in range(dims)] for j in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    first = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[first], vectors[:, first]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(first))] < 0, -1.0, 1.0)
    return Whitener(n, sums, vectors, values, float(np.trace(cov)))


def fit(distinct: DataFrame, components: int) -> dict[int, Whitener]:
    """A whitener for each length of vector in ``distinct`` (one binary column of packed vectors, each once)."""
    totals = distinct.mapInArrow(_totals, _TOTALS).groupBy("dims", "j", "k").agg(
        *[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)])
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in totals.collect():      # as many rows as the dimensions squared
        found.setdefault(r.dims, {})[r.j, r.k] = sum(r[f"l{i}"] << 32 * i for i in range(LIMBS))
    return {d: _solve(v[-1, -1], [v[j, -1] for j in range(d)],
                      [[v[min(j, k), max(j, k)] for k in range(d)] for j in range(d)], components)
            for d, v in found.items()}


def identity_error(distinct: DataFrame, model: dict[int, Whitener]) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance less the identity, of all lengths; None without rows.
    The rows are centred as integers, so their mean is 0 before anything is rounded."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in unpack(batch.column(0).to_pylist()) if batch.num_rows else []:
                own = model[x.shape[1]]
                w = own.whitened(own.centred(x))
                total[x.shape[1]] = total.get(x.shape[1], 0.0) + w.T @ w
        for dims, m in total.items():
            j, k = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), dims, dtype=np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(k.astype(np.int32)), pa.array(m[j, k])], names=["dims", "j", "k", "m"])

    cells = distinct.mapInArrow(moments, "dims int, j int, k int, m double").groupBy("dims", "j", "k").agg(F.sum("m").alias("m"))
    errors = [abs(r.m / model[r.dims].n - (r.j == r.k)) for r in cells.collect() if not np.isnan(r.m)]
    return max(errors, default=None)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16,
           scale: float = 64.0) -> DataFrame:
    """One row per remaining vector and component: vec_id, component (from 1), n (size of the fit list), deviation (sum of
    (n * x - S)^2, decimal), whitened, explained (share of the variance), identity_error."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(pack(integers(x, scale)), pa.binary())],
                                                 names=["vec_id", "x"])

    rows = written(rows.mapInArrow(make, "vec_id long, x binary"), "integers")
    distinct = written(rows.select("x").distinct(), "fit-list")
    model = fit(distinct, components)
    error = identity_error(distinct, model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in unpack(batch.column(1).to_pylist()) if batch.num_rows else []:
                own = model[x.shape[1]]
                centred = own.centred(x)
                # squares of longs may not fit a long
                wide = int(np.abs(centred).max(initial=0)) ** 2 * x.shape[1] >= 2 ** 63
                deviation = ((centred.astype(object) if wide else centred) ** 2).sum(axis=1)
                w = own.whitened(centred)
                share = own.explained()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array([own.n] * len(at), pa.int64()), pa.array([str(v) for v in deviation]),
                     pa.array(list(w), pa.list_(pa.float64())), pa.array([share] * len(at), pa.list_(pa.float64()))],
                    names=["vec_id", "n", "deviation", "whitened", "explained"])

    out = rows.mapInArrow(project, "vec_id long, n long, deviation string, whitened array<double>, explained array<double>")
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "pair")
    out = out.select("vec_id", "n", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), pairs)
    return out.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation",
                      F.nanvl("pair.whitened", F.lit(None).cast("double")).alias("whitened"), "pair.explained",
                      F.lit(error).cast("double").alias("identity_error"))
