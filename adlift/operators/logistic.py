"""Balanced L2 logistic regressions by Newton steps, all models in one pass a step.

A model is fitted on the rows of one group (an arm, say) without one fold, or on
all folds. Every step reads the rows once: each task adds up, for every model
its rows belong to, the weighted gradient, the Hessian and the loss at the
model's coefficients; a grouped sum over tasks leaves a few numbers a model, as
many as its features squared, and the driver solves for the next coefficients.
Models share the pass, so five folds of two arms and the arms themselves cost
as much reading as one model, and the steps (about eight) do not grow with the
data.

The objective is mean weighted loss + |w|^2 / (2 c n) with balanced class
weights and an unpenalised intercept; numeric inputs are scaled by mean and
sample deviation of the model's own rows, nominal ones are one-hot with all
levels, unknown levels are zero, and a missing number counts as the mean.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlift.operators.features import NOMINAL, NUMERIC

Key = tuple[str, int | None]     # group, fold left out

# tasks get these functions by value, so executors need numpy and pyarrow but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Logistic:
    """Coefficients in the order of ``names``: scaled numbers, levels of the nominal columns, the ordinal."""

    levels: dict[str, list[str]]
    mean: list[float]
    scale: list[float]          # 1 / deviation, 0 for a constant column
    coefficients: list[float]
    intercept: float

    def names(self) -> list[str]:
        return [f"num__{c}" for c in NUMERIC] + [f"nom__{c}_{v}" for c in NOMINAL for v in self.levels[c]] + ["ord__income_band"]

    def probability(self) -> Column:
        """P(label = 1) of a row with the feature columns and ``_income_ord``, in the JVM."""
        eta, left = F.lit(self.intercept), list(self.coefficients)
        for c, m, s in zip(NUMERIC, self.mean, self.scale, strict=True):
            eta = eta + F.coalesce((F.col(c).cast("double") - m) * (s * left.pop(0)), F.lit(0.0))
        for c in NOMINAL:
            for v in self.levels[c]:
                eta = eta + F.when(F.col(c) == v, left.pop(0)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-(eta + F.col("_income_ord") * left.pop(0))))


def _moments(frame: DataFrame, keys: list[Key]) -> dict[Key, tuple[float, float, np.ndarray, np.ndarray]]:
    """Rows, positives, means and sample deviations of each model's rows, merged from one row a group and fold."""
    numbers = [F.col(c).cast("double") for c in NUMERIC]
    cells = frame.groupBy("_group", "_fold").agg(
        F.count("*").alias("n"), F.sum("label").alias("p"), F.array(*[F.avg(c) for c in numbers]).alias("mean"),
        F.array(*[F.var_pop(c) for c in numbers]).alias("var")).collect()
    out = {}
    for group, without in keys:
        own = [r for r in cells if r["_group"] == group and (without is None or r["_fold"] != without)]
        n = sum(r.n for r in own)
        mean = sum((np.array(r.mean, float) * r.n for r in own), np.zeros(len(NUMERIC))) / max(n, 1)
        square = sum(((np.array(r["var"], float) + (np.array(r.mean, float) - mean) ** 2) * r.n for r in own), np.zeros(len(NUMERIC)))
        out[group, without] = (n, sum(r.p for r in own), mean, np.sqrt(square / max(n - 1, 1)))
    return out


def _arrays(batch: pa.RecordBatch, levels: dict[str, list[str]]) -> tuple[np.ndarray, ...]:
    """Numbers as they are, the other inputs with a last column of ones, labels, group numbers, and folds (NaN for null)."""
    at = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names) if name != "_group"}
    raw = np.column_stack([at[c] for c in NUMERIC])
    hot = [at[c][:, None] == np.arange(len(levels[c])) for c in NOMINAL]
    rest = np.column_stack([*hot, at["_income_ord"], np.ones(len(raw))]).astype(float)
    return raw, rest, at["label"].astype(float), at["_number"], at["_fold"].astype(float)


def _design(model: Logistic, raw: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return np.column_stack([np.nan_to_num((raw - model.mean) * model.scale), rest])


def held_out_scores(frame: DataFrame, models: dict[Key, Logistic]) -> DataFrame:
    """_group, _fold, label, score: each row by the model that left its fold out, rows without a fold by the whole model."""
    levels, groups = next(iter(models.values())).levels, sorted({g for g, _ in models})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, rest, _, group, fold = _arrays(batch, levels)
            out = np.full(len(raw), np.nan)
            for (g, without), own in models.items():
                rows = np.flatnonzero((group == groups.index(g)) & (np.isnan(fold) if without is None else fold == without))
                eta = _design(own, raw[rows], rest[rows]) @ np.array([*own.coefficients, own.intercept])
                out[rows] = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("_group", "_fold", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, mask=np.isnan(out))], names=["_group", "_fold", "label", "score"])
    return _inputs(frame, levels, groups, "_group").mapInArrow(score, "_group string, _fold int, label double, score double")


def _inputs(frame: DataFrame, levels: dict[str, list[str]], groups: list[str], *more: str) -> DataFrame:
    """Numbers only, so that Arrow columns are numpy arrays: groups (as _number) and levels by their place, -1 for none."""
    def place(c: str, values: list[str]) -> Column:
        return F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(0)) - 1 if values else F.lit(-1)
    doubles = [F.col(c).cast("double").alias(c) for c in (*NUMERIC, "label", "_income_ord")]
    return frame.select(*more, place("_group", groups).cast("int").alias("_number"), "_fold", *doubles,
                        *[place(c, levels[c]).cast("int").alias(c) for c in NOMINAL])


def _step(frame: DataFrame, groups: list[str], models: dict[Key, Logistic], weights: dict[Key, tuple[float, float]]) -> dict[Key, tuple[float, np.ndarray, np.ndarray]]:
    """Weighted loss, gradient and Hessian sums of every model at its coefficients: one pass, summed by model and entry."""
    order = list(models)
    first = models[order[0]]
    size = len(first.coefficients) + 1
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(order), 1 + size + len(upper[0])))
        for batch in batches:
            raw, rest, y, group, fold = _arrays(batch, first.levels)
            for m, key in enumerate(order):
                rows = np.flatnonzero((group == groups.index(key[0])) & (True if key[1] is None else fold != key[1]))
                if not len(rows):
                    continue
                own, yy = models[key], y[rows]
                x = _design(own, raw[rows], rest[rows])
                eta = x @ np.array([*own.coefficients, own.intercept])
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                w = np.where(yy == 1, *weights[key])
                hessian = x.T @ (x * (w * p * (1 - p))[:, None])
                loss = (w * (np.logaddexp(0, eta) - yy * eta)).sum()
                total[m] += np.concatenate(([loss], x.T @ (w * (p - yy)), hessian[upper]))
        model, entry = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(model.ravel().astype(np.int32)), pa.array(entry.ravel().astype(np.int32)),
                                          pa.array(total.ravel())], names=["model", "entry", "v"])

    cells = frame.mapInArrow(sums, "model int, entry int, v double").groupBy("model", "entry").agg(F.sum("v").alias("v"))
    total = np.zeros((len(order), 1 + size + len(upper[0])))
    for r in cells.collect():       # models times features squared
        total[r.model, r.entry] = r.v
    out = {}
    for m, key in enumerate(order):
        hessian = np.zeros((size, size))
        hessian[upper] = total[m, 1 + size:]
        out[key] = (total[m, 0], total[m, 1:1 + size], hessian + np.triu(hessian, 1).T)
    return out


def fit_logistic(frame: DataFrame, keys: list[Key], c: float = 1.0, max_iter: int = 50, tol: float = 1e-9,
                 least: float = 1e-20) -> dict[Key, Logistic]:
    """Fits a model for every (group, left-out fold) on ``frame``: _group, _fold, label, the feature columns and
    ``_income_ord``; it is read once a step, so pass a written table.

    A model is done when its step is below ``tol`` or can lower the objective by less than ``least``. The levels of a
    nominal column add up to the intercept's ones, a direction that only the penalty holds; its curvature falls as
    1 / n, and with millions of rows the rounding of the sums alone moves it by more than ``tol`` a step, for ever."""
    found = frame.agg(*[F.sort_array(F.collect_set(n)).alias(n) for n in NOMINAL]).first()     # the levels of fixed domains
    levels = {n: list(found[n]) for n in NOMINAL}
    size = len(NUMERIC) + sum(map(len, levels.values())) + 1
    moments = _moments(frame, keys)
    groups = sorted({g for g, _ in keys})
    frame = _inputs(frame, levels, groups)
    weights = {k: (n / (2 * p) if p else 0.0, n / (2 * (n - p)) if n > p else 0.0) for k, (n, p, _, _) in moments.items()}
    models = {k: Logistic(levels, m.tolist(), [1 / s if s > 0 else 0.0 for s in d], [0.0] * size, 0.0) for k, (_, _, m, d) in moments.items()}
    before = {k: (math.inf, None) for k in models}
    done: dict[Key, Logistic] = {k: m for k, m in models.items() if not moments[k][0]}
    for _ in range(max_iter):
        todo = {k: m for k, m in models.items() if k not in done}
        if not todo:
            break
        for k, (loss, gradient, hessian) in _step(frame, groups, todo, weights).items():
            n, own = moments[k][0], models[k]
            at = np.array([*own.coefficients, own.intercept])
            penalty = np.append(np.full(size, 1 / (c * n)), 0.0)
            value = loss / n + (penalty * at * at).sum() / 2
            if value > before[k][0] + 1e-12:
                new, gain = (at + before[k][1]) / 2, math.inf       # overshot: half way back
            else:
                slope = gradient / n + penalty * at
                move = np.linalg.solve(hessian / n + np.diag(penalty + 1e-14), slope)
                new, gain = at - move, slope @ move / 2
                before[k] = (value, at)
            models[k] = Logistic(levels, own.mean, own.scale, new[:-1].tolist(), float(new[-1]))
            if np.abs(new - at).max() < tol or not gain > least:     # not above: also where the inputs hold NaN
                done[k] = models[k]
    return models
