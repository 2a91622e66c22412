"""Regression on what a blend of candidates leaves, fitted without the fold it predicts, stored and applied later.

A target names the base that the trees correct: nothing ("abs"), the fixed blend ("resid"), or the blend by inverse
variances ("resid_adapt"), whose two error curves are fitted on the same training rows as the trees.  Every fit leaves one
folder: the pipeline of `pyspark.ml` and the curves.  Out-of-fold predictions are a table beside them."""

from __future__ import annotations

import json
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import bin_centers, curve_value
from .fuse import MD_BINS, NN_BINS, inverse_variance
from .metrics import binned_rms

TARGETS = ("abs", "resid", "resid_adapt")
#: Share of the first candidate in the fixed blend.
FIXED = 0.45


@dataclass(frozen=True)
class Spec:
    """Columns and tree settings.  truth: the value to reach, as a difference to the last known one, like both candidates."""
    features: tuple[str, ...]
    truth: str = "d"
    first: str = "dS"
    second: str = "dP"
    near: str = "nn_aniso"
    depth: str = "md_since"
    fold: str = "fold"
    min_rows: int = 20
    trees: int = 5
    levels: int = 3
    step: float = 0.2
    seed: int = 7


def fit_curves(train: DataFrame, spec: Spec) -> dict[str, list[float]]:
    """Error of the first candidate by distance to neighbours and of the second by depth since the cut; one number a bin."""
    d = F.col(spec.truth)
    out = {}
    for name, x, p, edges in (("near", spec.near, spec.first, NN_BINS), ("depth", spec.depth, spec.second, MD_BINS)):
        rows = binned_rms(train, F.col(x), (d - F.col(p)) * (d - F.col(p)), edges, spec.min_rows).orderBy("bin").collect()
        out[name] = [r.sigma if r.sigma is not None else 1.0 for r in rows]
    return out


def base(target: str, curves: dict[str, list[float]] | None, spec: Spec) -> Column:
    """The prediction that the trees correct."""
    a, b = F.col(spec.first), F.col(spec.second)
    if target == "abs":
        return F.lit(0.0)
    if target == "resid":
        return FIXED * a + (1 - FIXED) * b
    if target != "resid_adapt":
        raise ValueError(f"unknown target {target}")
    w = inverse_variance(F.greatest(curve_value(F.col(spec.near), bin_centers(NN_BINS), curves["near"]), F.lit(1e-6)),
                         F.greatest(curve_value(F.col(spec.depth), bin_centers(MD_BINS), curves["depth"]), F.lit(1e-6)))
    return w * a + (1 - w) * b


def _predict(model: PipelineModel, rows: DataFrame, target: str, curves: dict | None, spec: Spec) -> DataFrame:
    """rows with `base` and `pred`; features without a value are 0, as in training."""
    t = rows.withColumn("base", base(target, curves, spec))
    filled = t.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f_{c}") for c in spec.features])
    out = model.transform(filled)
    return out.select(*t.columns, (F.col("base") + F.col("prediction")).alias("pred"))


def fit(train: DataFrame, target: str, spec: Spec, path: str) -> None:
    """Fit one model on all rows of `train` and store it in the folder `path`."""
    curves = fit_curves(train, spec) if target == "resid_adapt" else None
    t = train.withColumn("__label", F.col(spec.truth) - base(target, curves, spec))
    t = t.select("__label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f_{c}") for c in spec.features])
    stages = [VectorAssembler(inputCols=[f"__f_{c}" for c in spec.features], outputCol="__features"),
              GBTRegressor(featuresCol="__features", labelCol="__label", maxIter=spec.trees, maxDepth=spec.levels, stepSize=spec.step, seed=spec.seed)]
    Pipeline(stages=stages).fit(t).write().overwrite().save(f"{path}/model")
    facts = json.dumps({"target": target, "features": spec.features, "curves": curves})
    train.sparkSession.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def apply(spark: SparkSession, path: str, rows: DataFrame, spec: Spec) -> DataFrame:
    """rows with `base` and `pred` of the model stored in `path`; rows need the features and both candidates, not the truth."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    if tuple(facts["features"]) != tuple(spec.features):
        raise ValueError("the model was fitted on other features")
    return _predict(PipelineModel.load(f"{path}/model"), rows, facts["target"], facts["curves"], spec)


def out_of_fold(table: DataFrame, target: str, spec: Spec, path: str, parallelism: int = 4) -> DataFrame:
    """Fit once without each fold, store every model under path/target/fold=k, and write and return path/target/oof: the table's
    rows with `base` and `pred` of the model that has not seen their fold.  Folds are whole groups, so no row of a group is in
    training when another of it is predicted.  Rows without a truth are predicted but not trained on.  Up to `parallelism` folds
    are fitted at a time, as in the tuning of `pyspark.ml`."""
    spark = table.sparkSession

    def one(k: int) -> None:
        own = f"{path}/{target}/fold={k}"
        fit(table.filter((F.col(spec.fold) != k) & F.col(spec.truth).isNotNull()), target, spec, own)
        apply(spark, own, table.filter(F.col(spec.fold) == k), spec).write.mode("overwrite").parquet(f"{path}/{target}/oof/part={k}")

    folds = [r[0] for r in table.select(spec.fold).distinct().orderBy(spec.fold).collect()]
    if folds:
        with ThreadPool(min(parallelism, len(folds))) as pool:
            pool.map(inheritable_thread_target(spark)(one), folds)
    return spark.read.parquet(f"{path}/{target}/oof").drop("part")
