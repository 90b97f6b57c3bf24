"""Model training re-aimed at ``pyspark.ml``.

* ``PopStdScaler``: z-scores with the population std (zero -> 1), fitted by
  one ``agg`` and applied as column arithmetic, so it sits inside the
  ``Pipeline`` and each cross-validation fold is scaled with its own training
  statistics (no leak).
* Classifiers: ``LogisticRegression`` with class weights (T3), multilayer
  perceptron (T2), a linear pairwise ranker (T4), time-to-event regressors
  (T5).  ``cross_validate`` runs the grid over the hash folds (T1); its
  ``parallelism`` is a driver thread pool that submits fold jobs side by
  side, the work itself runs on executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCols, Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import features as FT
from cohortkit.operators.sampling import with_sample_weight
from cohortkit.session import cut_lineage


class _ScalerParams(HasInputCols):
    means = Param(Params._dummy(), "means", "training means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "training population stds (0 -> 1)",
                 typeConverter=TypeConverters.toListFloat)


class PopStdScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        mu, sd = self.getOrDefault(self.means), self.getOrDefault(self.stds)
        z = {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, mu, sd)}
        return df.withColumns(z)


class PopStdScaler(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """A7 + J5 as an ML stage: fit = one aggregate, transform = arithmetic."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopStdScalerModel:
        cols = self.getInputCols()
        r = FT.fit_scaler(df, cols).first()
        return PopStdScalerModel(inputCols=cols, means=[float(r[f"mean_{c}"]) for c in cols],
                                 stds=[float(r[f"std_{c}"]) for c in cols])


def classifier_pipeline(estimator, features: Sequence[str] = FT.FEATURES) -> Pipeline:
    """Scaler + assembler + estimator: the scaler is refitted inside every
    training fold, and the fitted ``PipelineModel`` keeps both (T7)."""
    return Pipeline(stages=[PopStdScaler(inputCols=list(features)),
                            VectorAssembler(inputCols=list(features), outputCol="features"), estimator])


def weighted_logistic(label: str = "label") -> LogisticRegression:
    """Logistic loss with a positive-class weight (column ``weight``)."""
    return LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=100)


def mlp(n_features: int, label: str = "label", hidden: Sequence[int] = (100, 100, 100, 100),
        seed: int = 42, max_iter: int = 100) -> MultilayerPerceptronClassifier:
    """4 x 100 hidden units, two outputs (sigmoid hidden layers)."""
    return MultilayerPerceptronClassifier(labelCol=label, featuresCol="features",
                                          layers=[n_features, *hidden, 2], seed=seed, maxIter=max_iter)


def with_pos_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """T3 row weights.  ``BCEWithLogits(pos_weight = n_neg / n_pos)`` weighs
    positives n_neg / n_pos relative to negatives; inverse class frequency
    (1 / n_class, A6) has the same ratio, and Spark's weighted losses divide
    by the total weight, so the objective is the same."""
    return with_sample_weight(df, label, out)


def cross_validate(train: DataFrame, estimator, grid, label: str = "label", fold: str = "fold",
                   k: int = 10, parallelism: int = 4) -> CrossValidatorModel:
    """Grid x folds with the hash folds 1..k.  Returns the fitted
    ``CrossValidatorModel`` (with per-fold sub-models).

    The rows are stored once and a fold is a filter on the stored table;
    ``CrossValidator`` would work out the rows, their weights included, for
    every fold, and keep a copy of each fold's training part.
    """
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC", numBins=0)
    rows = cut_lineage(train, "cv")
    sizes = {r[fold] for r in rows.select(fold).distinct().collect()}
    if sizes != set(range(1, k + 1)) or k < 2:
        raise ValueError(f"fold numbers must be 1 to {k}, each with rows; found {sorted(sizes, key=str)}")

    def fit(job: tuple[int, int]):
        f, i = job
        model = estimator.fit(rows.where(F.col(fold) != f), grid[i])
        return model, ev.evaluate(model.transform(rows.where(F.col(fold) == f), grid[i]))

    jobs = [(f, i) for f in range(1, k + 1) for i in range(len(grid))]
    with ThreadPoolExecutor(parallelism) as pool:
        got = dict(zip(jobs, pool.map(fit, jobs)))
    metrics = [float(np.mean([got[f, i][1] for f in range(1, k + 1)])) for i in range(len(grid))]
    best = estimator.fit(rows, grid[int(np.argmax(metrics))])
    return CrossValidatorModel(best, avgMetrics=metrics, subModels=[[got[f, i][0] for i in range(len(grid))] for f in range(1, k + 1)])


def logistic_grid(lr: LogisticRegression, reg=(0.0, 0.01, 0.1)):
    return ParamGridBuilder().addGrid(lr.regParam, list(reg)).build()


def probability_of_one(df: DataFrame, out: str = "prob") -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1])


# --- T4: pairwise ranker -------------------------------------------------

def _padded(pdf: pd.DataFrame, features: list[str], batch: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole batches as a 3-d array (batch, place, feature), their labels, and which places are filled."""
    ids = pdf[batch].to_numpy()
    new = np.append(True, ids[1:] != ids[:-1])
    b = np.cumsum(new) - 1
    place = np.arange(len(ids)) - np.flatnonzero(new)[b]
    shape = (int(b[-1]) + 1, int(place.max()) + 1)
    x, y, on = np.zeros((*shape, len(features))), np.zeros(shape), np.zeros(shape, bool)
    x[b, place], y[b, place], on[b, place] = pdf[features].to_numpy(dtype=float), pdf["label"].to_numpy(), True
    return x, y, on


def _gradients(x: np.ndarray, y: np.ndarray, on: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per batch: rows, mean softplus(s_neg - s_pos) over its pairs, and the gradient for s = w . x.

    A batch has at most ``batch_size`` rows (X6), so the pairs of all batches
    of a chunk are one bounded array; no pair rows exist.
    """
    s = x @ w
    pos, neg = on & (y == 1), on & (y == 0)
    pair = neg[:, :, None] & pos[:, None, :]                    # (batch, negative, positive)
    d = np.where(pair, s[:, :, None] - s[:, None, :], 0.0)
    n = np.maximum(pair.sum(axis=(1, 2)), 1)
    loss = (np.where(pair, np.maximum(d, 0) + np.log1p(np.exp(-np.abs(d))), 0.0)).sum(axis=(1, 2)) / n
    sig = np.where(pair, 1.0 / (1.0 + np.exp(-d)), 0.0)
    # d/dw softplus(s_n - s_p) = sigmoid(d) * (x_n - x_p)
    grad = (np.einsum("bi,bif->bf", sig.sum(axis=2), x) - np.einsum("bj,bjf->bf", sig.sum(axis=1), x)) / n[:, None]
    return np.column_stack([on.sum(axis=1), loss, grad])


def _partition_gradients(features: list[str], batch: str, w: np.ndarray):
    """mapInPandas body: rows arrive sorted by batch inside a partition that
    holds whole batches; chunks are streamed and only the last, possibly
    incomplete batch is carried to the next chunk."""
    def rows(g: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_gradients(*_padded(g, features, batch), w))
        return out.astype({0: "int64"})

    def fn(chunks):
        carry = None
        for pdf in chunks:
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf[batch].to_numpy() == pdf[batch].iloc[-1]
            done, carry = pdf[~last], pdf[last]
            if len(done):
                yield rows(done)
        if carry is not None and len(carry):
            yield rows(carry)
    return fn


def fit_pairwise_ranker(batches: DataFrame, features: Sequence[str], batch: str = "batch_id",
                        iterations: int = 30, step: float = 0.5) -> np.ndarray:
    """T4: linear scorer trained on the pairwise AUC surrogate (M4).

    The batches are partitioned by batch id and sorted once, then
    checkpointed; each iteration is one narrow pass (``mapInPandas``) that
    yields one gradient row per batch, plus a size-weighted sum (M8).  The
    driver keeps only the d weights.
    """
    feats = list(features)
    w = np.zeros(len(feats))
    schema = "n long, loss double, " + ", ".join(f"g{i} double" for i in range(len(feats)))
    src = cut_lineage(batches.select(batch, "label", *feats).repartition(batch).sortWithinPartitions(batch))
    for _ in range(iterations):
        per = src.mapInPandas(_partition_gradients(feats, batch, w.copy()), schema)
        r = per.agg(F.sum("n").alias("n"), *[F.sum(F.col(f"g{i}") * F.col("n")).alias(f"g{i}")
                                             for i in range(len(feats))]).first()
        grad = np.array([r[f"g{i}"] for i in range(len(feats))]) / max(r["n"], 1)
        w = w - step * grad
    return w


def score_linear(df: DataFrame, features: Sequence[str], w: np.ndarray, out: str = "score") -> DataFrame:
    """Apply a linear scorer as a column expression."""
    s = sum((F.col(f) * float(c) for f, c in zip(features, w)), F.lit(0.0))
    return df.withColumn(out, s)


# --- fold models as columns ---------------------------------------------

def linear_parts(model) -> tuple[list[str], np.ndarray, float]:
    """(features, weights, intercept) on unscaled features of a fitted scaler + linear model, or of a ``LinearModel``."""
    if not isinstance(model, PipelineModel):
        return model.features, model.weights, model.intercept
    scaler, last = model.stages[0], model.stages[-1]
    mu, sd = (np.array(scaler.getOrDefault(p)) for p in (scaler.means, scaler.stds))
    w = last.coefficients.toArray() / sd
    return list(scaler.getInputCols()), w, float(last.intercept - (w * mu).sum())


def score_folds(df: DataFrame, models: dict[int, PipelineModel], out: str, link=lambda x: x,
                keep: Sequence[str] = (), own_fold: str | None = None) -> DataFrame:
    """Scores of the folds' linear models as rows (fold, ``keep``, ``out``), from one scan.

    Every row gets the score of every fold's model; with ``own_fold`` only
    that of the fold which it was held out of.
    """
    def score(model) -> Column:
        feats, w, b = linear_parts(model)
        return link(sum((F.col(f) * float(c) for f, c in zip(feats, w)), F.lit(b)))

    each = F.array(*[F.struct(F.lit(k).cast("long").alias("fold"), score(m).alias(out)) for k, m in sorted(models.items())])
    if own_fold:
        each = F.filter(each, lambda e: e["fold"] == F.col(own_fold))
    return df.select(*keep, F.explode(each).alias("_s")).select(*keep, "_s.fold", f"_s.{out}")


def fit_folds(train: DataFrame, pipeline: Pipeline, folds: Sequence[int], fold: str = "fold", parallelism: int = 4) -> dict[int, PipelineModel]:
    """One model per fold, fitted on the other folds' rows; fits are submitted side by side."""
    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(folds, pool.map(lambda f: pipeline.fit(train.where(F.col(fold) != f)), folds)))


# --- T5 ---------------------------------------------------------------

def time_regressor(kind: str = "linear", label: str = "target", loss: str = "squared"):
    """T5: time-to-event regressor (``linear`` or ``gbt``; GBT supports the
    absolute loss)."""
    if kind == "gbt":
        return GBTRegressor(labelCol=label, featuresCol="features", lossType=loss, maxIter=20, seed=42)
    return LinearRegression(labelCol=label, featuresCol="features", maxIter=100, solver="normal")


def save_model(model: PipelineModel, path: str) -> None:
    """Persist scaler + model together."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_fold_models(spark: SparkSession, folder: str, folds: Sequence[int]) -> dict[int, PipelineModel]:
    """The models under ``folder/fold=<f>``; a fold without an artifact is skipped."""
    from cohortkit.sources.tables import path_exists
    return {f: load_model(f"{folder}/fold={f}") for f in folds if path_exists(spark, f"{folder}/fold={f}")}


__all__ = ["PopStdScaler", "PopStdScalerModel", "classifier_pipeline", "weighted_logistic", "mlp",
           "with_pos_weight", "cross_validate", "logistic_grid", "probability_of_one", "fit_pairwise_ranker",
           "score_linear", "linear_parts", "score_folds", "fit_folds", "time_regressor", "save_model", "load_model",
           "load_fold_models", "feature_order"]


def feature_order(df: DataFrame, vector_col: str = "features") -> list[str]:
    """Feature names in vector order, from the ML attribute metadata
    that ``VectorAssembler`` stores on the vector column."""
    attrs = df.schema[vector_col].metadata.get("ml_attr", {}).get("attrs", {})
    named = [a for group in attrs.values() for a in group]
    return [a["name"] for a in sorted(named, key=lambda a: a["idx"])]
