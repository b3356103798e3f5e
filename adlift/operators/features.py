"""Feature engineering, encoders and the train/test split."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from adlift.functions.guards import require_columns
from adlift.functions.numeric import div_or_zero
from adlift.functions.ranking import exact_medians
from adlift.operators.audience import hash_number
from adlift.sources.schema import INCOME_BANDS

NUMERIC = ["age", "customer_tenure", "historical_spend", "product_count", "spend_per_product", "engagement_score"]
NOMINAL = ["gender", "geography", "channel"]
ORDINAL = ["income_band"]
FEATURES = NUMERIC + ["gender", "geography", "income_band", "channel"]


@dataclass(frozen=True)
class FeatureConstants:
    """Normalisers fitted once (on training data) and reused for scoring."""

    spend_median: float
    spend_max: float


def fit_feature_constants(df: DataFrame, approx: bool = False, accuracy: int = 100_000) -> FeatureConstants:
    """Median and maximum of historical_spend (two numbers to the driver).
    ``approx=True`` uses ``percentile_approx``; the exact median comes from
    distributed ranks."""
    top = df.agg(F.max("historical_spend").alias("x"))
    if approx:
        row = df.agg(F.percentile_approx("historical_spend", 0.5, accuracy).alias("m"), F.max("historical_spend").alias("x")).first()
    else:
        row = exact_medians(df, {"historical_spend": "m"}).crossJoin(top).first()
    return FeatureConstants(float(row["m"]), float(row["x"]))


def feature_columns(constants_df: DataFrame | None = None) -> dict[str, Column]:
    spend, products, tenure = F.col("historical_spend"), F.col("product_count"), F.col("customer_tenure")
    return {
        "spend_per_product": spend / (products + 1),
        "high_value": (spend > F.col("_spend_median")).cast("int"),
        "engagement_score": (tenure / 120) * 0.4 + (products / 5) * 0.3 + div_or_zero(spend, "_spend_max") * 0.3,
    }


def add_features(df: DataFrame, constants: FeatureConstants | None = None) -> DataFrame:
    """G1: spend per product, high-value flag, engagement score.

    Without ``constants`` the median / max come from ``df`` itself as a lazy
    one-row aggregate cross-joined in (the reference's per-call behaviour);
    with them, fitted constants are reused (training and scoring agree).
    """
    require_columns(df, ["historical_spend", "product_count", "customer_tenure"], "features input")
    if constants is None:
        consts = exact_medians(df, {"historical_spend": "_spend_median"}).crossJoin(
            df.agg(F.max("historical_spend").alias("_spend_max")))
        base = df.crossJoin(F.broadcast(consts))  # one row
    else:
        base = df.withColumn("_spend_median", F.lit(constants.spend_median)) \
                 .withColumn("_spend_max", F.lit(constants.spend_max))
    out = base
    for name, c in feature_columns().items():
        out = out.withColumn(name, c)
    return out.drop("_spend_median", "_spend_max")


def training_frame(df: DataFrame, target: str = "converted", constants: FeatureConstants | None = None,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """The ten model inputs plus the target (and the columns ``keep``)."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataframe.")
    feats = add_features(df, constants)
    require_columns(feats, FEATURES, "feature frame")
    keys = [c for c in ("customer_id", "campaign_id") if c in df.columns]
    return feats.select(*keys, *FEATURES, F.col(target).cast("double").alias("label"), *keep)


def income_ordinal(col: str = "income_band") -> Column:
    """Ordinal code of the ordered income bands; unknown bands are -1."""
    expr = F.lit(-1.0)
    for i, band in reversed(list(enumerate(INCOME_BANDS))):
        expr = F.when(F.col(col) == band, F.lit(float(i))).otherwise(expr)
    return expr


def encoder_stages() -> list:
    """Scaled numerics, one-hot nominals (all known levels kept, unknown ->
    zero vector), ordinal income band; assembled into ``features``."""
    stages = [VectorAssembler(inputCols=NUMERIC, outputCol="_num"),
              StandardScaler(inputCol="_num", outputCol="_num_scaled", withMean=True, withStd=True)]
    for c in NOMINAL:
        stages.append(StringIndexer(inputCol=c, outputCol=f"_{c}_idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
    stages.append(OneHotEncoder(inputCols=[f"_{c}_idx" for c in NOMINAL],
                                outputCols=[f"_{c}_oh" for c in NOMINAL], dropLast=True, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=["_num_scaled", *[f"_{c}_oh" for c in NOMINAL], "_income_ord"],
                                  outputCol="features"))
    return stages


def with_ordinal(df: DataFrame) -> DataFrame:
    return df.withColumn("_income_ord", income_ordinal())


def feature_names(model) -> list[str]:
    """Names of the assembled vector slots, in order (sklearn-like prefixes)."""
    names = [f"num__{c}" for c in NUMERIC]
    indexers = [s for s in model.stages if hasattr(s, "labelsArray")]
    for c, idx in zip(NOMINAL, indexers):
        names += [f"nom__{c}_{lvl}" for lvl in idx.labelsArray[0]] + [f"nom__{c}_?"]     # the slot of unknown levels
    return names + ["ord__income_band"]


def _in_cells(df: DataFrame, classes: list[str], keys: list[str], seed: int, cells: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with _h, a hash of the keys, and _cell, its range of ``cells`` equal ones; and a table of the rows of each class
    and range: _class0.., _at, _n, the rows before it in the class (_before) and the rows of the class (_size)."""
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    marked = df.withColumn("_h", hash_number(key, seed)).withColumn("_cell", F.floor(F.col("_h") / (2 ** 32 // cells)))
    names = [f"_class{i}" for i in range(len(classes))]
    sizes = marked.groupBy(*[F.col(c).alias(n) for c, n in zip(classes, names, strict=True)], F.col("_cell").alias("_at")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*names).orderBy("_at")
    sizes = sizes.select(*names, "_at", "_n", (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(*names)).alias("_size"))
    return marked, sizes


def _alike(classes: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_class{i}")) for i, c in enumerate(classes)])


def class_rank(df: DataFrame, label: str, keys: list[str], seed: int = 42, cells: int = 1 << 14, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with _rank, each row's place (from 1) in its class by key hash, and _size, its class's rows; a class is
    the rows alike in ``by`` and ``label``.

    The hashes are cut into ``cells`` equal ranges; counts of the ranges before
    come from that bounded table, and only rows of one range are sorted
    together, so no class is sorted in one task.
    """
    classes = [*by, label]
    marked, sizes = _in_cells(df, classes, keys, seed, cells)
    inside = Window.partitionBy(*classes, "_cell").orderBy("_h", *keys)
    ranked = marked.join(F.broadcast(sizes), _alike(classes) & (F.col("_cell") == F.col("_at")))     # classes x cells
    return (ranked.withColumn("_rank", F.col("_before") + F.row_number().over(inside))
            .drop("_h", "_cell", "_at", "_n", "_before", *[f"_class{i}" for i in range(len(classes))]))


def stratified_split(df: DataFrame, label: str = "label", test_share: float = 0.2, seed: int = 42,
                     keys: list[str] | None = None, by: tuple[str, ...] = (), cells: int = 1 << 14) -> DataFrame:
    """Deterministic split with an exact quota per class (the rows alike in ``by`` and ``label``): the first
    round(share * rows) rows of a class, by key hash, are the test rows. Counts of hash ranges tell in which range the
    quota ends; only its rows are ranked, the others are told by their range. ``df`` is read three times."""
    require_columns(df, [label], "split input")
    keys = keys or [c for c in ("customer_id", "campaign_id") if c in df.columns]
    classes = [*by, label]
    marked, sizes = _in_cells(df, classes, keys, seed, cells)
    names = [f"_class{i}" for i in range(len(classes))]
    quota = F.floor(F.col("_size") * test_share + 0.5)
    ends = sizes.where((F.col("_before") < quota) & (quota <= F.col("_before") + F.col("_n")))
    ends = ends.select(*names, F.col("_at").alias("_end"), (quota - F.col("_before")).alias("_take"))     # a row a class
    rows = marked.join(F.broadcast(ends), _alike(classes), "left")
    at_end = F.coalesce(F.col("_cell") == F.col("_end"), F.lit(False))
    clear = rows.where(~at_end).withColumn("_test", F.col("_cell") < F.col("_end"))
    ranked = rows.where(at_end).withColumn("_test", F.row_number().over(Window.partitionBy(*classes).orderBy("_h", *keys)) <= F.col("_take"))
    return (clear.unionByName(ranked).withColumn("split", F.when(F.col("_test"), "test").otherwise("train"))
            .drop("_h", "_cell", "_end", "_take", "_test", *names))


def stratified_folds(df: DataFrame, folds: int, label: str = "label", seed: int = 42,
                     keys: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``_fold`` from 0; the rows of a class are dealt to the folds in turn, by key hash."""
    keys = keys or [c for c in ("customer_id", "campaign_id") if c in df.columns]
    ranked = class_rank(df, label, keys, seed, by=by)
    return ranked.withColumn("_fold", F.pmod(F.col("_rank"), F.lit(folds)).cast("int")).drop("_rank", "_size")
