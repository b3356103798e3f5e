"""Exact rank arithmetic without a single-partition sort.

``orderBy(...).limit(n)`` with a large ``n`` and ``Window.orderBy`` without a
partition key both funnel every row through one task. The helpers here keep
the work distributed:

1. reduce to DISTINCT values with their row counts (partial aggregation, so a
   value held by a third of all rows is one row here);
2. cut the value range into ``bins`` buckets (by default as many as shuffle
   partitions, 256 at least) at approximate quantiles (the
   split points are a bounded list of numbers) and bucket with ``Bucketizer``;
3. prefix sums over the per-bucket totals (``bins`` rows) plus a windowed
   prefix sum inside each bucket give, for every distinct value, the exact
   number of rows that precede it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from adlift.session import written


def _splits(df: DataFrame, col: str, bins: int, rel_err: float) -> list[float]:
    probs = [i / bins for i in range(1, bins)]
    qs = df.approxQuantile(col, probs, rel_err) if bins > 1 else []
    inner = sorted({float(q) for q in qs if q is not None}) or [0.0]    # an empty table has no quantile
    return [float("-inf")] + inner + [float("inf")]


def rank_offsets(df: DataFrame, col: str, descending: bool = False, bins: int | None = None,
                 sums: dict[str, Column] | None = None, rel_err: float = 1e-3, by: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct value of ``col``: ``n_at`` rows with that value and
    ``n_before`` rows strictly before it in the chosen order, plus optional
    per-value sums (``sums``) and their running totals ``<name>_before``, all within the rows alike in ``by`` (few groups)."""
    sums = sums or {}
    bins = bins or max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = F.col(col).cast("double")
    keyed = df.where(F.col(col).isNotNull()).select(*by, F.col(col), (-v if descending else v).alias("_k"),
                                                    *[c.alias(n) for n, c in sums.items()])
    distinct = keyed.groupBy(*by, col, "_k").agg(F.count(F.lit(1)).alias("n_at"), *[F.sum(n).alias(n) for n in sums])
    distinct = written(distinct, "distinct")    # ``df`` is read once, whatever it is made of
    splits = _splits(distinct, "_k", bins, rel_err)
    b = Bucketizer(splits=splits, inputCol="_k", outputCol="_b", handleInvalid="keep").transform(distinct)
    names = ["n_at", *sums]
    totals = b.groupBy(*by, "_b").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    # at most ``bins`` rows: an unpartitioned window over the bucket totals is bounded
    prior = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(prior), F.lit(0)).alias(f"_o_{n}")
                                    for n in names])
    # the value itself orders: large integers may share a double
    order = F.col(col).desc() if descending else F.col(col).asc()
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = b.join(F.broadcast(offsets), [*by, "_b"])
    for n in names:
        out = out.withColumn(f"{n}_before" if n != "n_at" else "n_before",
                             F.col(f"_o_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return out.select(*by, col, *names, "n_before", *[f"{n}_before" for n in sums])


@dataclass(frozen=True)
class Rank:
    """The value at a place of a column in rising order, the rows before its equals, and the number of its equals."""

    value: object
    before: int
    equal: int


@dataclass(frozen=True)
class _Bracket:
    """Least and greatest value that may stand at a place of a column, the rows below it and the rows inside."""

    col: str
    place: int
    low: object
    high: object
    below: int
    inside: int

    def holds(self) -> Column:
        return F.col(self.col).between(F.lit(self.low), F.lit(self.high))


def _narrowed(df: DataFrame, wide: list[_Bracket], accuracy: int) -> list[_Bracket]:
    """Each bracket between two sketched quantiles about its place: a pass for the sketches, a pass to count."""
    def quantiles(b: _Bracket) -> Column:
        at, slack = (b.place - b.below + 0.5) / b.inside, 2 / accuracy
        probs = F.array(F.lit(max(0.0, at - slack)), F.lit(min(1.0, at + slack)))
        return F.percentile_approx(F.when(b.holds(), F.col(b.col)), probs, accuracy)
    ends = df.agg(*[quantiles(b).alias(str(i)) for i, b in enumerate(wide)]).first()
    tight = [replace(b, low=ends[i][0], high=ends[i][1]) for i, b in enumerate(wide)]
    counts = df.agg(*[c for i, b in enumerate(tight) for c in (
        F.count_if(F.col(b.col) < F.lit(b.low)).alias(f"below{i}"), F.count_if(b.holds()).alias(f"inside{i}"))]).first()
    tight = [replace(b, below=counts[f"below{i}"], inside=counts[f"inside{i}"]) for i, b in enumerate(tight)]
    return [t if t.below <= t.place < t.below + t.inside and t.inside < b.inside else _halved(df, b) for b, t in zip(wide, tight, strict=True)]


def _halved(df: DataFrame, b: _Bracket) -> _Bracket:
    """Where a sketch missed the place or nothing was cut off: the side of a middle value that holds the place, or it."""
    x = F.col(b.col)
    middle = F.lit(df.where(b.holds()).agg(F.percentile_approx(x, 0.5, 100)).first()[0])
    r = df.where(b.holds()).agg(F.count_if(x < middle).alias("less"), F.count_if(x == middle).alias("same"), F.max(F.when(x < middle, x)).alias("under"),
                                F.min(F.when(x > middle, x)).alias("over"), F.max(F.when(x == middle, x)).alias("at")).first()
    start = b.below + r["less"]
    if b.place < start:
        return replace(b, high=r["under"], inside=r["less"])
    if b.place < start + r["same"]:
        return replace(b, low=r["at"], high=r["at"], below=start, inside=r["same"])
    return replace(b, low=r["over"], below=start + r["same"], inside=b.inside - r["less"] - r["same"])


def order_statistics(df: DataFrame, places: dict[str, Callable[[int], list[int]]], accuracy: int = 10_000,
                     few: int = 50_000) -> dict[str, list[Rank]]:
    """Exact values at places of columns (from 0, in rising order, nulls left out): a Rank for each place that ``places``
    gives for the column's count, in order; places outside the column are left out.

    Bracket and refine: mergeable sketches bracket all places in one pass, a second pass counts the rows below and
    inside the brackets, and again inside these until at most ``few`` rows or one value are left, whose distinct values
    come to the driver. Nothing is sorted, and each round cuts the candidates by about accuracy / 4. ``df`` is read
    twice a round: pass a written table.
    """
    df = df.select(*places)
    row = df.agg(*[c for i, n in enumerate(places) for c in (
        F.count(n).alias(f"n{i}"), F.min(n).alias(f"low{i}"), F.max(n).alias(f"high{i}"))]).first()
    brackets = [_Bracket(c, p, row[f"low{i}"], row[f"high{i}"], 0, row[f"n{i}"]) for i, (c, f) in enumerate(places.items())
                for p in f(row[f"n{i}"]) if 0 <= p < row[f"n{i}"]]
    while wide := [b for b in brackets if b.inside > few and b.low != b.high]:
        done = [b for b in brackets if b not in wide]
        brackets = done + _narrowed(df, wide, accuracy)
    found: dict[str, dict[_Bracket, Rank]] = {c: {} for c in places}
    for b in (b for b in brackets if b.low == b.high):
        found[b.col][b] = Rank(b.low, b.below, b.inside)
    for c in places:
        own = [b for b in brackets if b.col == c and b.low != b.high]
        marks = F.array(*[F.when(b.holds(), F.lit(i)) for i, b in enumerate(own)])
        inside = df.select(c, F.explode(F.array_compact(marks)).alias("i")).groupBy("i", c).count().collect() if own else []
        for i, b in enumerate(own):
            before = b.below
            for value, equal in sorted((r[c], r["count"]) for r in inside if r["i"] == i):
                if before <= b.place < before + equal:
                    found[c][b] = Rank(value, before, equal)
                before += equal
    return {c: [r for _, r in sorted(v.items(), key=lambda x: x[0].place)] for c, v in found.items()}


def exact_medians(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """One row with the exact median of every column (alias by column in ``cols``), null without values. The columns are
    written once and their middle values selected together; a median aggregate would keep a counter per distinct value
    in one task."""
    slim = written(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "medians")
    middle = order_statistics(slim, {c: lambda n: [(n - 1) // 2, n // 2] for c in cols})
    return df.sparkSession.range(1).select(*[
        F.lit(middle[c][0].value * 0.5 + middle[c][-1].value * 0.5 if middle[c] else None).cast("double").alias(alias)
        for c, alias in cols.items()])


def top_n_rows(df: DataFrame, col: str, n: int, key: list[str], descending: bool = True,
               bins: int | None = None) -> DataFrame:
    """Exactly the first ``n`` rows by ``col`` (ties go to the smaller ``key``), without
    a global sort; rows without a value are left out. Exactly one distinct value
    straddles the cut (it is selected, not ranked): rows before it are kept by a
    comparison, and its own rows, which may be a large part of the table, are cut
    by the next key column in the same way. ``df`` is read several times: pass a written table."""
    return _first_rows(df, F.col(col), n, [F.col(k) for k in key], descending, bins or 10_000)


def _first_rows(df: DataFrame, value: Column, n: int, key: list[Column], descending: bool, accuracy: int) -> DataFrame:
    if n <= 0:
        return df.limit(0)
    rows = df.agg(F.count(value)).first()[0]
    cut = order_statistics(df.select(value.alias("_v")), {"_v": lambda m: [m - n if descending else n - 1]}, accuracy)["_v"]
    if not cut:
        return df.where(value.isNotNull())
    cut = cut[0]
    at, take = F.lit(cut.value), n - (rows - cut.before - cut.equal if descending else cut.before)
    if take == cut.equal:
        return df.where(value >= at if descending else value <= at)
    kept, ties = df.where(value > at if descending else value < at), df.where(value == at)
    if key and _numeric(ties, key[0]):
        part = _first_rows(ties, key[0], take, key[1:], descending=False, accuracy=accuracy)
    else:   # names are left to order, among rows alike in all numeric keys
        part = ties.orderBy(*key).limit(take)
    return kept.unionByName(part)


def _numeric(df: DataFrame, column: Column) -> bool:
    """Whether ranks of the column are safe: a number, never null here."""
    field = df.select(column.alias("_c")).schema["_c"]
    return isinstance(field.dataType, NumericType) and df.where(column.isNull()).isEmpty()
