"""Plans of the sweep and of training loops: T1-T4, T6, W6, W7, S9, S10, M12 with their results in the rows.

Where the model has one 0/1 feature its fit, or every step of it, depends on
four counts a fold, and the whole flow is checked against SQL (a closed form,
or a recursive CTE that takes the same steps).
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import history as HS
from cohortkit.operators import loop as LP
from cohortkit.operators import metrics as MT
from cohortkit.operators import networks as NW
from cohortkit.operators import perceptron as PC
from cohortkit.operators import sampling as SM
from cohortkit.operators import splits as SP
from cohortkit.operators import sweep as SW
from cohortkit.operators import training as TR
from cohortkit.plans import training as PT
from cohortkit.plans.features import features as feature_rows
from cohortkit.plans.features import stored_split_features
from cohortkit.plans.oracle import CTE, _DEPS, with_ctes
from cohortkit.plans.registry import query
from cohortkit.session import cut_lineage, ensure_checkpoint_dir

K, FOLDS, FEATS, ONE, SEED = PT.K, PT.FOLDS, PT.FEATS, PT.ONE, PT.SEED
REGS = (0.0, 0.01, 0.1)
LOGISTIC_RULE, LOGISTIC_STEP = LP.Rule(check_every=5, patience=3, min_delta=1e-3, max_epochs=60), 0.5
PAIRWISE_RULE = LP.Rule(check_every=5, patience=2, min_delta=1e-3, max_epochs=30)


@query("sweep_grid", None, "T1,T3,T6,M3 (every fold and grid point, fitted and validated together)")
def q_sweep_grid(spark, sf):
    train, _ = PT._train_test(spark, sf)
    sweep = SW.fit_logistic_sweep(train, FEATS, REGS, FOLDS)
    auc = SW.grid_metrics(train, sweep)
    best = SW.best_point(auc, REGS)
    return auc.withColumn("chosen", (F.col("reg") == best).cast("int"))


@query("sweep_coefficients", None, "T1,T3 (weights on unscaled features of every fold and grid point)")
def q_sweep_coefficients(spark, sf):
    train, _ = PT._train_test(spark, sf)
    sweep = SW.fit_logistic_sweep(train, FEATS, REGS, FOLDS)
    rows = [(f, g, name, round(float(w), 6)) for (f, g), m in sweep.models.items() for name, w in [("(intercept)", m.intercept), *zip(m.features, m.weights)]]
    return spark.createDataFrame(rows, "fold long, reg double, term string, weight double")


CTE["sat_shares"] = f"""
SELECT f.fold, x.Hypertension AS h, count(CASE WHEN x.label = 1 THEN 1 END) / any_value(w.n1) AS pos, count(CASE WHEN x.label = 0 THEN 1 END) / any_value(w.n0) AS neg
FROM (SELECT CAST(unnest(range(1, {K} + 1)) AS BIGINT) AS fold) f
JOIN feat x ON x.is_test = 0 AND x.fold <> f.fold,
     (SELECT count(CASE WHEN label = 1 THEN 1 END) AS n1, count(CASE WHEN label = 0 THEN 1 END) AS n0 FROM feat WHERE is_test = 0) w
GROUP BY f.fold, x.Hypertension"""
_DEPS["sat_shares"] = ["feat"]


@query("sweep_saturated", with_ctes("""
SELECT a.fold, round(ln(a.pos / a.neg), 6) AS intercept, round(ln(b.pos / b.neg) - ln(a.pos / a.neg), 6) AS weight
FROM sat_shares a JOIN sat_shares b ON a.fold = b.fold AND a.h = 0 AND b.h = 1""", "sat_shares"), "T1,T3 (coefficients, closed form)")
def q_sweep_saturated(spark, sf):
    train, _ = PT._train_test(spark, sf)
    models = SW.fit_logistic_sweep(train, ONE, (0.0,), FOLDS).models
    rows = [(f, round(m.intercept, 6), round(float(m.weights[0]), 6)) for (f, _), m in models.items()]
    return spark.createDataFrame(rows, "fold long, intercept double, weight double")


# --- training loops -----------------------------------------------------------

def run_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/fit-{uuid.uuid4().hex}"


def logistic_loop(train: DataFrame, features, folder: str, rule: LP.Rule = LOGISTIC_RULE, **how) -> tuple[DataFrame, LP.FoldFrames]:
    """Weighted logistic loss with early stopping on each fold's held-out rows: (last state, scalers)."""
    frames = LP.fold_frames(train, features, FOLDS)
    scan = LP.logistic_scan(train, features, FOLDS, frames)
    start = np.zeros((len(FOLDS), len(features) + 1))
    return LP.train_loop(train.sparkSession, folder, folder.rsplit("/", 1)[-1], FOLDS, start, scan, rule, LOGISTIC_STEP, **how), frames


def loop_result(spark: SparkSession, folder: str, state: DataFrame, rule: LP.Rule) -> DataFrame:
    """What early stopping says of each fold: from the loop's state, its last epoch from the log."""
    last = LP.read_log(spark, folder, rule).groupBy("fold").agg(F.max("epoch").alias("last_epoch"))
    return state.join(last, "fold").select("fold", "n_checks", "best_epoch", F.round("best_loss", 6).alias("best_loss"), "stop_epoch", "last_epoch")


def replayed(spark: SparkSession, folder: str, rule: LP.Rule) -> DataFrame:
    """W6 / W7 replayed over the run's own log."""
    log = LP.read_log(spark, folder, rule).where("metric = 'val_loss'").select("fold", "epoch", F.col("value").alias("val_loss"))
    return HS.early_stop(log, "fold", patience=rule.patience, min_delta=rule.min_delta, check_every=rule.check_every)


@query("fit_early_stop", None, "T1,T3,W6,W7,W8,S9,S10 (a real fit, all features)")
def q_fit_early_stop(spark, sf):
    train, _ = PT._train_test(spark, sf)
    folder = run_folder(spark)
    state, _ = logistic_loop(train, FEATS, folder)
    return loop_result(spark, folder, state, LOGISTIC_RULE)


_S = "({b} + {a} * ({h} - mu) / sd)"


def _each(form: str, b: str, a: str, prefix: str) -> str:
    """Sum over the four (feature, label) cells of their weight times ``form``."""
    return " + ".join(f"{prefix}{h}{y} * (" + form.format(s=_S.format(b=b, a=a, h=h), y=y, z=f"(({h} - mu) / sd)") + ")" for h in (0, 1) for y in (0, 1))


_ERR, _LOSS = "1 / (1 + exp(-{s})) - {y}", "greatest({s}, 0) + ln(1 + exp(-abs({s}))) - {y} * {s}"
_R = LOGISTIC_RULE
_BETTER = f"(chk AND vl + {_R.min_delta} < best)"
_LOOP_SQL = f""",
w AS (SELECT 1.0 / count(CASE WHEN label = 1 THEN 1 END) AS w1, 1.0 / count(CASE WHEN label = 0 THEN 1 END) AS w0 FROM feat WHERE is_test = 0),
s AS (SELECT f.fold, avg(x.Hypertension) FILTER (WHERE x.fold <> f.fold) AS mu, stddev_pop(x.Hypertension) FILTER (WHERE x.fold <> f.fold) AS sd,
      {", ".join(f"count(*) FILTER (WHERE x.fold {op} f.fold AND x.Hypertension = {h} AND x.label = {y}) * any_value(w.w{y}) AS {p}{h}{y}"
                 for p, op in (("t", "<>"), ("v", "=")) for h in (0, 1) for y in (0, 1))}
      FROM (SELECT CAST(unnest(range(1, {K} + 1)) AS BIGINT) AS fold) f JOIN feat x ON x.is_test = 0, w GROUP BY f.fold),
r(fold, epoch, b, a, best, best_e, misses, n, stop) AS (
  SELECT fold, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 'inf'::DOUBLE, NULL::BIGINT, 0, 0, NULL::BIGINT FROM s
  UNION ALL
  SELECT fold, e, b2, a2, CASE WHEN {_BETTER} THEN vl ELSE best END, CASE WHEN {_BETTER} THEN e ELSE best_e END,
         CASE WHEN {_BETTER} THEN 0 WHEN chk THEN misses + 1 ELSE misses END, CASE WHEN chk THEN n + 1 ELSE n END,
         CASE WHEN chk AND NOT {_BETTER} AND misses + 1 >= {_R.patience} THEN e END
  FROM (SELECT *, ({_each(_LOSS, 'b2', 'a2', 'v')}) / (v00 + v01 + v10 + v11) AS vl, e % {_R.check_every} = 0 AS chk
        FROM (SELECT s.*, r.epoch + 1 AS e, best, best_e, misses, n,
                     b - {LOGISTIC_STEP} * ({_each(_ERR, 'b', 'a', 't')}) / (t00 + t01 + t10 + t11) AS b2,
                     a - {LOGISTIC_STEP} * ({_each('(' + _ERR + ') * {z}', 'b', 'a', 't')}) / (t00 + t01 + t10 + t11) AS a2
              FROM r JOIN s ON s.fold = r.fold WHERE r.stop IS NULL AND r.epoch < {_R.max_epochs}) x) y)
SELECT fold, CAST(n AS BIGINT) AS n_checks, best_e AS best_epoch, round(best, 6) AS best_loss, stop AS stop_epoch, epoch AS last_epoch
FROM r WHERE epoch = (SELECT max(epoch) FROM r q WHERE q.fold = r.fold)"""


@query("fit_early_stop_saturated", with_ctes("SELECT 1", "feat").rsplit("SELECT 1", 1)[0].rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + _LOOP_SQL,
       "T3,W6,W7,W8,S9 (every step of the fit by a recursive CTE)")
def q_fit_early_stop_saturated(spark, sf):
    train, _ = PT._train_test(spark, sf)
    folder = run_folder(spark)
    state, _ = logistic_loop(train, ONE, folder)
    return loop_result(spark, folder, state, LOGISTIC_RULE)


def pairwise_loop(spark: SparkSession, sf: str, folder: str, rule: LP.Rule = PAIRWISE_RULE, **how):
    """T4 with W7: balanced draws of each fold's training part in batches of 32; its held-out rows, in batches, are the check."""
    s = stored_split_features(spark, sf)
    train, test = SP.train_rows(s), SP.test_rows(s)
    frames = LP.fold_frames(train, FEATS, FOLDS)
    draws = SM.balanced_draws(SM.training_parts(train, "fold", K), "Code", "label", SEED, 32, by=["fold"])
    held = SM.batches(train, "Code", SEED, 64)
    scan = LP.pairwise_scan(draws, held, FEATS, FOLDS, frames)
    state = LP.train_loop(spark, folder, folder.rsplit("/", 1)[-1], FOLDS, np.zeros((K, len(FEATS) + 1)), scan, rule, 0.5, **how)
    return state, frames, test


@query("fit_early_stop_pairwise", None, "T4,W7,W8,S9,J4,M4,X5,X6 (proxy-AUC loss, all folds)")
def q_fit_early_stop_pairwise(spark, sf):
    folder = run_folder(spark)
    state, _, _ = pairwise_loop(spark, sf, folder)
    return loop_result(spark, folder, state, PAIRWISE_RULE)


@query("ranker_by_followup", None, "T4,T6,W7,M9 (restored weights of every fold on the test set)")
def q_ranker_by_followup(spark, sf):
    state, frames, test = pairwise_loop(spark, sf, run_folder(spark))
    models = LP.best_models(state, FEATS, frames, FOLDS)
    # A ranker has no cut of its own: the sigmoid of its score is compared with one half, as the reference does.
    return PT.evaluate(TR.score_folds(test, models, "prob", MT.sigmoid, PT.ROW))


@query("pairwise_ranker_scores", None, "T4 (the score of every test row)")
def q_ranker_scores(spark, sf):
    return PT.ranker_scores(spark, sf)


# --- networks -----------------------------------------------------------------

def network_scores(spark: SparkSession, sf: str, max_iter: int = 25) -> DataFrame:
    """A 4 x 100 network per fold; all of them score the test rows in one scan."""
    train, test = PT._train_test(spark, sf, weighted=False)
    models = PC.fit_networks(train, TR.mlp(len(FEATS), max_iter=max_iter), FEATS, FOLDS)
    return NW.score_networks(test, models, FEATS, "prob", PT.ROW)


@query("mlp_fold_probabilities", None, "T2,T6 (probability of every test row under every fold's network)")
def q_mlp_fold_probabilities(spark, sf):
    return network_scores(spark, sf).withColumn("prob", F.round("prob", 6))


@query("keras_rule_network", None, "T2,P25,P26,M9 (double softmax and >= 0.731 on the networks, three subsets)")
def q_keras_rule_network(spark, sf):
    s = network_scores(spark, sf).withColumn("soft", MT.softmax2("prob", 2))
    return MT.metrics_by_followup(s, "label", "soft", "dateAssess", PT.KERAS_YEARS, by=["fold"], threshold=MT.CUTOFF_KERAS, inclusive=True)


# --- M12 ----------------------------------------------------------------------

@query("feature_order", with_ctes(
    " UNION ALL ".join(f"SELECT {i} AS position, '{f}' AS feature, round(avg({f}), 6) AS mean FROM feat" for i, f in enumerate(FEATS)), "feat"),
       "M12 (names by place in the model's vector, with the place's mean)")
def q_feature_order(spark, sf):
    x = VectorAssembler(inputCols=FEATS, outputCol="features").transform(feature_rows(spark, sf))
    names = F.array(*(F.lit(n) for n in TR.feature_order(x)))
    per = x.select(F.posexplode(vector_to_array("features")).alias("position", "v")).groupBy("position").agg(F.round(F.avg("v"), 6).alias("mean"))
    return per.select("position", F.get(names, F.col("position")).alias("feature"), "mean")
