"""Training plans (T1-T7): cross-validated classifiers, ranker, regressors,
every fold's model on the test set.

Rows that many fits read are written once as a table in the shared folder.
Where a fit has a closed form (a weighted logistic on one 0/1 feature gives
weighted class shares, a least-squares line has its textbook slope) the whole
flow is checked against SQL; for the other models the columns that do not
depend on the optimiser are.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import features as FT
from cohortkit.operators import history as HS
from cohortkit.operators import lad as LD
from cohortkit.operators import metrics as MT
from cohortkit.operators import perceptron as PC
from cohortkit.operators import sampling as SM
from cohortkit.operators import splits as SP
from cohortkit.operators import sweep as SW
from cohortkit.operators import training as TR
from cohortkit.plans import evaluation as EV
from cohortkit.plans.cohort import cohort
from cohortkit.plans.features import stored_split_features
from cohortkit.plans.oracle import CTE, _DEPS, with_ctes
from cohortkit.plans.registry import query
from cohortkit.session import cut_lineage

SEED = 42
K = 10
FOLDS = range(1, K + 1)
GRID = (0.0, 0.01)
PARALLEL_FITS = 8  # fits submitted side by side (driver threads; the work runs on executors)
FIT_ROWS = 1 << 17  # rows of a task in fits that pass over their rows a hundred times and run side by side
FEATS = FT.FEATURES
ONE = ["Hypertension"]  # a 0/1 feature: the fit is saturated
ROW = ("Code", "label", "dateAssess")
KERAS_YEARS = (0, 5, 10)


def _train_test(spark: SparkSession, sf: str, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Training rows, with their weights if asked for (networks take none), and test rows."""
    s = stored_split_features(spark, sf)
    train = SP.train_rows(s)
    return TR.with_pos_weight(train, "label") if weighted else train, SP.test_rows(s)


def cv_fit(spark: SparkSession, sf: str, features: Sequence[str] = FEATS, grid: Sequence[float] = GRID,
           tol: float = 1e-6) -> tuple[dict[int, PipelineModel], DataFrame, DataFrame]:
    """Grid x folds; the sub-model of every fold at the best grid point, training rows, test rows.

    With one grid point there is nothing to choose: one fit per fold, side by side.
    """
    train, test = _train_test(spark, sf)
    lr = TR.weighted_logistic().setTol(tol)
    if len(grid) == 1:
        pipe = TR.classifier_pipeline(lr.setRegParam(grid[0]), features)
        return TR.fit_folds(train, pipe, FOLDS, parallelism=PARALLEL_FITS), train, test
    cvm = TR.cross_validate(train, TR.classifier_pipeline(lr, features), TR.logistic_grid(lr, grid), k=K,
                            parallelism=PARALLEL_FITS)
    best = int(np.argmax(np.nan_to_num(cvm.avgMetrics)))
    return {f: cvm.subModels[f - 1][best] for f in FOLDS}, train, test


def saturated_fit(spark: SparkSession, sf: str):
    return cv_fit(spark, sf, ONE, (0.0,), tol=1e-9)


def fold_fit(spark: SparkSession, sf: str):
    """The folds' models at the grid's best point (mean validation AUC), all fitted together: models, training and test rows."""
    train, test = _train_test(spark, sf)
    sweep = SW.fit_logistic_sweep(train, FEATS, GRID, FOLDS)
    best = SW.best_point(SW.grid_metrics(train, sweep), GRID)
    return {f: sweep.models[f, best] for f in FOLDS}, train, test


def validation_scores(models: dict[int, PipelineModel], train: DataFrame) -> DataFrame:
    """Every fold's model on the rows held out of it, in one scan."""
    return TR.score_folds(train, models, "prob", MT.sigmoid, ROW, own_fold="fold")


def test_scores(models: dict[int, PipelineModel], test: DataFrame) -> DataFrame:
    """Every fold's model on all test rows, in one scan."""
    return TR.score_folds(test, models, "prob", MT.sigmoid, ROW)


def _exact(scored: DataFrame) -> DataFrame:
    """Probabilities of a saturated fit without the optimiser's last digits."""
    return scored.withColumn("prob", F.round("prob", 3))


def evaluate(scored: DataFrame) -> DataFrame:
    """M9: metrics per fold and follow-up threshold."""
    return MT.metrics_by_followup(scored, "label", "prob", "dateAssess", KERAS_YEARS, by=["fold"])


# --- closed form of the saturated fit ---------------------------------------

CTE["sat_prob"] = f"""
SELECT f.fold, x.Hypertension AS h,
       round((count(CASE WHEN x.label = 1 THEN 1 END) / any_value(w.n1)) /
             (count(CASE WHEN x.label = 1 THEN 1 END) / any_value(w.n1) + count(CASE WHEN x.label = 0 THEN 1 END) / any_value(w.n0)), 3) AS prob
FROM (SELECT CAST(unnest(range(1, {K} + 1)) AS BIGINT) AS fold) f
JOIN feat x ON x.is_test = 0 AND x.fold <> f.fold,
     (SELECT count(CASE WHEN label = 1 THEN 1 END) AS n1, count(CASE WHEN label = 0 THEN 1 END) AS n0 FROM feat WHERE is_test = 0) w
GROUP BY f.fold, x.Hypertension"""
_DEPS["sat_prob"] = ["feat"]
CTE["sat_test"] = """
SELECT p.fold, x.Code, x.label AS y, x.dateAssess, p.prob FROM feat x JOIN sat_prob p ON p.h = x.Hypertension WHERE x.is_test = 1"""
_DEPS["sat_test"] = ["sat_prob"]
CTE["sat_val"] = """
SELECT p.fold, x.Code, x.label AS y, x.dateAssess, p.prob
FROM feat x JOIN sat_prob p ON p.h = x.Hypertension AND p.fold = x.fold WHERE x.is_test = 0"""
_DEPS["sat_val"] = ["sat_prob"]
CTE["sat_followup"] = """
SELECT s.fold, t.years, s.y, s.prob FROM sat_test s JOIN (SELECT unnest([0, 5, 10]) AS years) t
  ON t.years = 0 OR s.dateAssess >= t.years * 365"""
_DEPS["sat_followup"] = ["sat_test"]
CTE["sat_eval"] = f"""
SELECT r.*, a.auc FROM ({EV._rates_sql('sat_followup', 'fold, years')}) r
LEFT JOIN ({EV._auc_sql('sat_followup', 'fold, years')}) a USING (fold, years)"""
_DEPS["sat_eval"] = ["sat_followup"]


@query("cv_logistic", None, "T1,T3,T6,A6,M3")
def q_cv_logistic(spark, sf):
    models, train, _ = fold_fit(spark, sf)
    val = validation_scores(models, train)
    return MT.auc(val, "label", "prob", ["fold"]).join(
        val.groupBy("fold").agg(F.count(F.lit(1)).alias("n")), "fold")


@query("cv_saturated", with_ctes(f"""
SELECT a.fold, a.auc, n.n FROM ({EV._auc_sql('sat_val', 'fold')}) a JOIN (SELECT fold, count(*) AS n FROM sat_val GROUP BY fold) n USING (fold)""",
                                 "sat_val"), "T1,T3,T6,A6,M3 (closed form)")
def q_cv_saturated(spark, sf):
    models, train, _ = cv_fit(spark, sf, ONE, (0.0, 0.0), tol=1e-9)  # two equal grid points: the search is run
    val = _exact(validation_scores(models, train))
    return MT.auc(val, "label", "prob", ["fold"]).join(
        val.groupBy("fold").agg(F.count(F.lit(1)).alias("n")), "fold")


@query("eval_all_folds", None, "T6,M9 (every fold's model on the test set)")
def q_eval_all_folds(spark, sf):
    models, _, test = fold_fit(spark, sf)
    return evaluate(test_scores(models, test))


@query("eval_summary", None, "T6,M9,M10")
def q_eval_summary(spark, sf):
    models, _, test = fold_fit(spark, sf)
    return MT.fold_summary(evaluate(test_scores(models, test)), EV.RATE_COLS, ["years"])


@query("eval_counts", with_ctes(f"""
SELECT f.fold, t.years, count(*) AS n, count(CASE WHEN x.label = 1 THEN 1 END) AS n_pos
FROM feat x, (SELECT CAST(unnest(range(1, {K} + 1)) AS BIGINT) AS fold) f, (SELECT unnest([0, 5, 10]) AS years) t
WHERE x.is_test = 1 AND (t.years = 0 OR x.dateAssess >= t.years * 365) GROUP BY f.fold, t.years""", "feat"), "T6,M9 (counts of eval_all_folds)")
def q_eval_counts(spark, sf):
    models, _, test = fold_fit(spark, sf)
    e = evaluate(test_scores(models, test))
    return e.select("fold", "years", "n", (F.col("tp") + F.col("fn")).alias("n_pos"))


@query("eval_saturated", with_ctes("SELECT * FROM sat_eval", "sat_eval"), "T3,T6,M9 (closed form)")
def q_eval_saturated(spark, sf):
    models, _, test = saturated_fit(spark, sf)
    return evaluate(_exact(test_scores(models, test)))


@query("eval_saturated_summary", with_ctes("SELECT years, count(*) AS n_folds, " + EV.summary_columns(EV.RATE_COLS)
                                           + " FROM sat_eval GROUP BY years", "sat_eval"), "T6,M10 (closed form)")
def q_eval_saturated_summary(spark, sf):
    models, _, test = saturated_fit(spark, sf)
    return MT.fold_summary(evaluate(_exact(test_scores(models, test))), EV.RATE_COLS, ["years"])


_SOFT2 = "1 / (1 + exp(1 - 2 * (1 / (1 + exp(1 - 2 * prob)))))"


@query("keras_rule_saturated", with_ctes(f"""
SELECT fold, years, count(CASE WHEN y = 0 AND NOT k THEN 1 END) AS tn, count(CASE WHEN y = 0 AND k THEN 1 END) AS fp,
       count(CASE WHEN y = 1 AND NOT k THEN 1 END) AS fn, count(CASE WHEN y = 1 AND k THEN 1 END) AS tp
FROM (SELECT *, {_SOFT2} >= 0.731 AS k FROM sat_followup) s GROUP BY fold, years""", "sat_followup"),
       "T2 rule on a fitted model: double softmax, >= 0.731, three subsets")
def q_keras_rule(spark, sf):
    models, _, test = saturated_fit(spark, sf)
    s = _exact(test_scores(models, test)).withColumn("soft", MT.softmax2("prob", 2))
    e = MT.metrics_by_followup(s, "label", "soft", "dateAssess", KERAS_YEARS, by=["fold"], threshold=MT.CUTOFF_KERAS, inclusive=True)
    return e.select("fold", "years", "tn", "fp", "fn", "tp")


def best_validation_fold(val: DataFrame) -> int:
    """F1 - 0.1 |precision - recall| on the validation rows."""
    per = MT.rates(MT.confusion(val.withColumn("pred", MT.classify("prob")), "label", "pred", ["fold"]))
    return int(HS.best_fold(per.select("fold", "f1", "precision", "recall"), HS.balanced_score()).first()["fold"])


@query("score_best_fold", None, "T6,T7,W9,M9")
def q_score_best_fold(spark, sf):
    """The best fold's pipeline (its own scaler and model) scores the test rows per threshold."""
    models, train, test = fold_fit(spark, sf)
    bf = best_validation_fold(validation_scores(models, train))
    return evaluate(test_scores({bf: models[bf]}, test))


@query("best_fold_saturated", with_ctes(f"""
SELECT e.* FROM sat_eval e WHERE e.fold = (SELECT fold FROM ({EV._rates_sql('sat_val', 'fold')}) r
  ORDER BY f1 - 0.1 * abs(precision - recall) DESC, fold LIMIT 1)""", "sat_eval", "sat_val"), "T6,T7,W9,M9 (closed form)")
def q_best_fold_saturated(spark, sf):
    models, train, test = saturated_fit(spark, sf)
    bf = best_validation_fold(_exact(validation_scores(models, train)))
    return evaluate(_exact(test_scores({bf: models[bf]}, test)))


@query("mlp_classifier", None, "T2,T6")
def q_mlp(spark, sf):
    train, test = _train_test(spark, sf, weighted=False)
    model = PC.fit_networks(train, TR.mlp(len(FEATS), max_iter=50), FEATS, [0])[0]
    out = TR.probability_of_one(model.transform(test))
    return out.select("Code", "label", F.round("prob", 6).alias("prob"), F.col("prediction").cast("int").alias("pred"))


@query("mlp_folds", with_ctes(f"""
SELECT f.fold, x.Code, x.label, 1 AS valid FROM feat x, (SELECT CAST(unnest(range(1, {K} + 1)) AS BIGINT) AS fold) f
WHERE x.is_test = 1""", "feat"), "T2,T6 (a network per fold; valid: probability in [0, 1] that agrees with the class)")
def q_mlp_folds(spark, sf):
    train, test = _train_test(spark, sf, weighted=False)
    models = PC.fit_networks(train, TR.mlp(len(FEATS)), FEATS, FOLDS)
    out = None
    for f, m in models.items():
        p = TR.probability_of_one(m.transform(test))
        ok = F.col("prob").between(0, 1) & ((F.col("prob") > 0.5) == (F.col("prediction") == 1))
        part = p.select(F.lit(f).cast("long").alias("fold"), "Code", "label", ok.cast("int").alias("valid"))
        out = part if out is None else out.unionByName(part)
    return out


def ranker_scores(spark: SparkSession, sf: str) -> DataFrame:
    """T4: rebalanced draws in batches of 32 -> pairwise ranker -> test scores."""
    s = stored_split_features(spark, sf)
    train = SP.train_rows(s)
    stats = FT.fit_scaler(train, FEATS)
    z_train = FT.scale(train, stats, FEATS, on=())
    draws = SM.balanced_draws(z_train, "Code", "label", SEED, 32)
    w = TR.fit_pairwise_ranker(draws, FEATS, iterations=20)
    z_test = FT.scale(SP.test_rows(s), stats, FEATS, on=())
    return TR.score_linear(z_test, FEATS, w).select(*ROW, F.round("score", 6).alias("score"))


@query("pairwise_ranker", with_ctes("SELECT Code, label, dateAssess, 1 AS scored FROM feat WHERE is_test = 1", "feat"),
       "T4,J4,M4,X5,X6 (scored: a finite score)")
def q_ranker(spark, sf):
    s = ranker_scores(spark, sf)
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return s.select(*ROW, ok.cast("int").alias("scored"))


# --- time to event -----------------------------------------------------------

def regression_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events only, target = follow-up years, 80/20 split, folds over the 80: (training rows, test rows)."""
    c = FT.to_years(cohort(spark, sf, "max"), "dateAssess", "days", out="years")
    c = FT.event_time_target(c, "years", "Eskd", out="target").where(F.col("Eskd") == 1)
    x = FT.feature_frame(c, keep=("target",))
    s = cut_lineage(SP.plain_split(x, "Code", SEED, 0.2, K), "regression")
    return SP.train_rows(s), SP.test_rows(s)


def in_full_tasks(rows: DataFrame) -> DataFrame:
    """The rows in at most one task per ``FIT_ROWS`` of them; the number of tasks still grows with the rows.

    A tree's level is a pass of its own, so that small tasks cost more than
    their rows; the folds' fits side by side keep all cores busy.
    """
    return rows.coalesce(max(1, -(-rows.count() // FIT_ROWS)))


def regressors(train: DataFrame, kind: str, features: Sequence[str] = FEATS) -> dict[int, PipelineModel]:
    pipe = Pipeline(stages=[TR.PopStdScaler(inputCols=list(features)),
                            VectorAssembler(inputCols=list(features), outputCol="features"), TR.time_regressor(kind)])
    return TR.fit_folds(in_full_tasks(train), pipe, FOLDS, parallelism=K)


def regression_predictions(models: dict[int, PipelineModel], rows: DataFrame, kind: str) -> DataFrame:
    """(fold, target, pred): every fold's model on all rows, clamped."""
    if kind == "linear":
        return TR.score_folds(rows, models, "pred", MT.clamp, ("target",))
    out = None
    for f, m in models.items():
        part = m.transform(rows).select("target", F.lit(f).cast("long").alias("fold"), MT.clamp("prediction").alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out


def regression_errors(spark: SparkSession, sf: str) -> DataFrame:
    train, test = regression_rows(spark, sf)
    test = in_full_tasks(test)
    with ThreadPoolExecutor(2) as pool:
        fits = dict(zip(("linear", "gbt"), pool.map(lambda kind: regressors(train, kind), ("linear", "gbt"))))
    out = None
    for kind, models in fits.items():
        e = MT.regression_errors(regression_predictions(models, test, kind), "target", "pred", ["fold"])
        out = e.withColumn("kind", F.lit(kind)) if out is None else out.unionByName(e.withColumn("kind", F.lit(kind)))
    return out


@query("time_regressor", None, "T5,P22,P23,P27,M7,X2,X4 (both estimators, every fold's model on the test part)")
def q_time_regressor(spark, sf):
    return regression_errors(spark, sf).select("kind", "fold", "n", "mae", "mse", "rmse", "r2")


@query("time_regressor_summary", None, "T5,M11")
def q_time_regressor_summary(spark, sf):
    return MT.fold_summary(regression_errors(spark, sf), ["mae", "rmse", "r2"], ["kind"])


_H = "md5(concat('{seed}|', CAST(Code AS VARCHAR)))"
CTE["reg_rows"] = f"""
SELECT Code, Age, target, CAST(rk <= (n + 4) // 5 AS INTEGER) AS is_test,
       CASE WHEN rk <= (n + 4) // 5 THEN 0 ELSE (rk - (n + 4) // 5 - 1) % {K} + 1 END AS fold
FROM (SELECT Code, coalesce(CAST(Age AS DOUBLE), 0.0) AS Age, dateAssess / 365.25 AS target,
             row_number() OVER (ORDER BY {_H.format(seed=SEED)}, Code) AS rk, count(*) OVER () AS n
      FROM cohort_max WHERE Eskd = 1) r"""
_DEPS["reg_rows"] = ["cohort_max"]
CTE["reg_line"] = f"""
SELECT CAST(f.fold AS BIGINT) AS fold, regr_slope(x.target, x.Age) AS b, regr_intercept(x.target, x.Age) AS a
FROM (SELECT unnest(range(1, {K} + 1)) AS fold) f JOIN reg_rows x ON x.is_test = 0 AND x.fold <> f.fold GROUP BY f.fold"""
_DEPS["reg_line"] = ["reg_rows"]
_ERR = "least(greatest(l.a + l.b * x.Age, 0.0), 10.0) - x.target"


@query("regression_line", with_ctes(f"""
SELECT l.fold, count(*) AS n, round(avg(abs({_ERR})), 6) AS mae, round(sqrt(avg(({_ERR}) * ({_ERR}))), 6) AS rmse
FROM reg_line l, reg_rows x WHERE x.is_test = 1 GROUP BY l.fold""", "reg_line"),
       "T5,T6,M7,P27,X2,X4 (least-squares line per fold on the test part: closed form)")
def q_regression_line(spark, sf):
    train, test = regression_rows(spark, sf)
    e = MT.regression_errors(regression_predictions(regressors(train, "linear", ["Age"]), test, "linear"), "target", "pred", ["fold"])
    return e.select("fold", "n", "mae", "rmse")


# --- absolute loss -------------------------------------------------------------

@query("regression_median", with_ctes(f"""
SELECT fold, count(*) AS n, round(avg(abs(target - m)), 6) AS train_mae FROM (
  SELECT f.fold, x.target, median(x.target) OVER (PARTITION BY f.fold) AS m
  FROM (SELECT CAST(unnest(range(1, {K} + 1)) AS BIGINT) AS fold) f JOIN reg_rows x ON x.is_test = 0 AND x.fold <> f.fold) r GROUP BY fold""", "reg_rows"),
       "T5 (absolute loss without features: the distance from the median)")
def q_regression_median(spark, sf):
    train, _ = regression_rows(spark, sf)
    rows = [(f, a.n, round(a.loss, 6)) for f, a in LD.fit_absolute(train, [], FOLDS).items()]
    return spark.createDataFrame(rows, "fold long, n long, train_mae double")


@query("regression_absolute", None, "T5,T6,M7,P27 (absolute loss, all features, every fold's model on the test part)")
def q_regression_absolute(spark, sf):
    train, test = regression_rows(spark, sf)
    fits = LD.fit_absolute(train, FEATS, FOLDS)
    pred = TR.score_folds(test, {f: a.model for f, a in fits.items()}, "pred", MT.clamp, ("target",))
    own = spark.createDataFrame([(f, round(a.loss, 6), a.gap, a.subgradient) for f, a in fits.items()], "fold long, train_mae double, gap double, subgradient double")
    return MT.regression_errors(pred, "target", "pred", ["fold"]).join(own, "fold")
