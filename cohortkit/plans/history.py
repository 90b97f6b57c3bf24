"""Training-history queries: early stopping, best epoch / fold / config,
previous-best comparison, metric log (W6-W9, S9, S10, J3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions import recode as R
from cohortkit.operators import history as HS
from cohortkit.operators import metrics as MT
from cohortkit.plans import evaluation as _ev  # noqa: F401  (defines the scores CTE)
from cohortkit.plans.evaluation import scores
from cohortkit.plans.oracle import CTE, _DEPS, with_ctes
from cohortkit.plans.registry import query
from cohortkit.sources import fixtures as fx

K = 10
HALF = 30  # epochs already logged by the previous sweep (S10 stand-in)


def history(spark: SparkSession, sf: str) -> DataFrame:
    return fx.fx_history(spark, sf)


def per_fold_rates(spark: SparkSession, sf: str) -> DataFrame:
    s = scores(spark, sf).withColumn("pred", MT.classify("prob"))
    return MT.rates(MT.confusion(s, "y", "pred", ["fold"]))


def best_per_fold(log: DataFrame) -> DataFrame:
    """Sweep runs are assigned to folds; each fold keeps the first
    (run, epoch) with the highest validation F1 (strict improvement)."""
    h = log.withColumn("fold", (F.col("run_id") % K + 1).cast("long"))
    f1 = R.nan_to_null("val_f1")
    key = F.when(f1.isNotNull(), F.struct(f1, -F.col("run_id"), -F.col("epoch")))
    pay = F.struct("run_id", F.col("epoch").alias("best_epoch"), "val_f1", R.nan_to_null("val_loss").alias("val_loss"))
    return h.groupBy("fold").agg(F.max_by(pay, key).alias("_b")).where(F.col("_b").isNotNull()).select("fold", "_b.*")


def best_config_per_fold(spark: SparkSession, sf: str) -> DataFrame:
    return best_per_fold(history(spark, sf))


CTE["cfg"] = f"""
SELECT fold, run_id, epoch AS best_epoch, val_f1, CASE WHEN NOT isnan(val_loss) THEN val_loss END AS val_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY val_f1 DESC, run_id, epoch) AS rn
  FROM (SELECT *, CAST(run_id % {K} + 1 AS BIGINT) AS fold FROM fx_history WHERE NOT isnan(val_f1)) h) t WHERE rn = 1"""
_DEPS["cfg"] = ["fx_history"]
CTE["rates"] = """
SELECT fold, tn, fp, fn, tp,
       round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT fold, count(CASE WHEN y = 0 AND prob <= 0.5 THEN 1 END) AS tn,
             count(CASE WHEN y = 0 AND prob > 0.5 THEN 1 END) AS fp,
             count(CASE WHEN y = 1 AND prob <= 0.5 THEN 1 END) AS fn,
             count(CASE WHEN y = 1 AND prob > 0.5 THEN 1 END) AS tp FROM scores GROUP BY fold) c"""
_DEPS["rates"] = ["scores"]


def _early_stop_sql(patience: int, every: int) -> str:
    """Window formulation (exact when min_delta = 0): a check improves when
    its loss is below every earlier check; the run stops at the first check
    that many checks after the last improvement."""
    flagged = f"""
      SELECT *, ci - coalesce(max(CASE WHEN imp THEN ci END) OVER (PARTITION BY run_id ORDER BY epoch
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cnt
      FROM (SELECT *, coalesce(val_loss < coalesce(prev, CAST('inf' AS DOUBLE)), false) AS imp
            FROM (SELECT run_id, epoch, val_loss, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS ci,
                         min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
                  FROM fx_history WHERE epoch % {every} = 0) a) b"""
    upto = "f.epoch <= coalesce(s.stop_epoch, 9223372036854775807)"
    return with_ctes(f"""
SELECT l.run_id, count(CASE WHEN {upto} THEN f.epoch END) AS n_checks,
       max(CASE WHEN f.imp AND {upto} THEN f.epoch END) AS best_epoch,
       round(min(CASE WHEN f.imp AND {upto} THEN f.val_loss END), 6) AS best_loss,
       s.stop_epoch, l.last_epoch
FROM (SELECT run_id, max(epoch) AS last_epoch FROM fx_history GROUP BY run_id) l
LEFT JOIN ({flagged}) f ON f.run_id = l.run_id
LEFT JOIN (SELECT run_id, min(CASE WHEN cnt >= {patience} THEN epoch END) AS stop_epoch FROM ({flagged}) c GROUP BY run_id) s
  ON s.run_id = l.run_id
GROUP BY l.run_id, s.stop_epoch, l.last_epoch""", "fx_history")


@query("early_stop", _early_stop_sql(2, 5), "W6 (check every 5 epochs, patience 2)")
def q_early_stop(spark, sf):
    return HS.early_stop(history(spark, sf), patience=2, min_delta=0.0, check_every=5)


@query("early_stop_interval", _early_stop_sql(3, 5), "W7 (check every 5 epochs, 3 misses, best restored)")
def q_early_stop_interval(spark, sf):
    return HS.early_stop(history(spark, sf), patience=3, min_delta=0.0, check_every=5)


_DELTA_BODY = """
c AS (SELECT run_id, epoch, val_loss, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS ci FROM fx_history),
r(run_id, ci, best, best_e, cnt, stop, n) AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT), CAST('inf' AS DOUBLE), CAST(NULL AS BIGINT), 0, CAST(NULL AS BIGINT), 0
  FROM fx_history
  UNION ALL
  SELECT r.run_id, r.ci + 1,
         CASE WHEN coalesce(c.val_loss + 0.01 < r.best, false) THEN c.val_loss ELSE r.best END,
         CASE WHEN coalesce(c.val_loss + 0.01 < r.best, false) THEN c.epoch ELSE r.best_e END,
         CASE WHEN coalesce(c.val_loss + 0.01 < r.best, false) THEN 0 ELSE r.cnt + 1 END,
         CASE WHEN NOT (coalesce(c.val_loss + 0.01 < r.best, false)) AND r.cnt + 1 >= 5 THEN c.epoch END,
         r.n + 1
  FROM r JOIN c ON c.run_id = r.run_id AND c.ci = r.ci + 1 WHERE r.stop IS NULL)
SELECT r.run_id, CAST(r.n AS BIGINT) AS n_checks, r.best_e AS best_epoch,
       CASE WHEN r.best_e IS NOT NULL THEN round(r.best, 6) END AS best_loss,
       r.stop AS stop_epoch, l.last_epoch
FROM r JOIN (SELECT run_id, max(ci) AS mci FROM r GROUP BY run_id) m ON m.run_id = r.run_id AND m.mci = r.ci
JOIN (SELECT run_id, max(epoch) AS last_epoch FROM fx_history GROUP BY run_id) l ON l.run_id = r.run_id"""


@query("early_stop_delta", "WITH RECURSIVE fx_history AS (" + CTE["fx_history"] + "\n),\n" + _DELTA_BODY,
       "W6 (min_delta 0.01, patience 5: a fold, oracle: recursive CTE)")
def q_early_stop_delta(spark, sf):
    return HS.early_stop(history(spark, sf), patience=5, min_delta=0.01, check_every=1)


@query("best_epoch", with_ctes("""
SELECT run_id, CASE WHEN f IS NOT NULL THEN epoch END AS best_epoch, f AS best_val_f1,
       CASE WHEN f IS NOT NULL AND NOT isnan(val_loss) THEN val_loss END AS val_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f DESC NULLS LAST, epoch) AS rn
  FROM (SELECT *, CASE WHEN NOT isnan(val_f1) THEN val_f1 END AS f FROM fx_history) h) t
WHERE rn = 1""", "fx_history"), "W8")
def q_best_epoch(spark, sf):
    h = history(spark, sf).withColumn("val_loss", R.nan_to_null("val_loss"))
    return HS.best_epoch(h, metric="val_f1", carry=["val_loss"])


@query("best_config_per_fold", with_ctes("SELECT * FROM cfg", "cfg"), "W8,S10 (best over all runs of a fold)")
def q_best_config(spark, sf):
    return best_config_per_fold(spark, sf)


@query("fold_config_join", with_ctes("""
SELECT c.fold, c.run_id, c.best_epoch, c.val_f1, r.accuracy, r.f1
FROM cfg c JOIN rates r USING (fold)""", "cfg", "rates"), "J3")
def q_fold_config(spark, sf):
    cfg = best_config_per_fold(spark, sf)
    r = per_fold_rates(spark, sf)
    return cfg.join(r, "fold").select("fold", "run_id", "best_epoch", "val_f1", "accuracy", "f1")


@query("best_fold_balanced", with_ctes("""
SELECT fold, f1, precision, recall, round(f1 - 0.1 * abs(precision - recall), 6) AS score FROM (
  SELECT *, row_number() OVER (ORDER BY f1 - 0.1 * abs(precision - recall) DESC, fold) AS rn FROM rates) t
WHERE rn = 1""", "rates"), "W9")
def q_best_fold(spark, sf):
    per = per_fold_rates(spark, sf).select("fold", "f1", "precision", "recall")
    b = HS.best_fold(per, HS.balanced_score())
    return b.withColumn("score", F.round("score", 6))


@query("previous_best", with_ctes(f"""
SELECT c.run_id, c.best AS val_f1, coalesce(CASE WHEN NOT isnan(p.best) THEN p.best END, 0.0) AS prev_best,
       CAST(coalesce(NOT isnan(c.best) AND c.best > coalesce(CASE WHEN NOT isnan(p.best) THEN p.best END, 0.0), false) AS INTEGER) AS improved
FROM (SELECT run_id, max(CASE WHEN NOT isnan(val_f1) THEN val_f1 END) AS best FROM fx_history WHERE epoch > {HALF} GROUP BY run_id) c
LEFT JOIN (SELECT run_id, max(val_f1) AS best FROM fx_history WHERE epoch <= {HALF} GROUP BY run_id) p
USING (run_id)""", "fx_history"), "S10")
def q_previous_best(spark, sf):
    h = history(spark, sf)
    cur = h.where(F.col("epoch") > HALF).groupBy("run_id").agg(F.max(R.nan_to_null("val_f1")).alias("val_f1"))
    stored = h.where(F.col("epoch") <= HALF).groupBy("run_id").agg(F.max("val_f1").alias("val_f1"))
    return HS.previous_best(cur, stored, "run_id", "val_f1")


@query("metric_log", with_ctes("""
SELECT run_id, epoch, metric, CASE WHEN NOT isnan(value) THEN round(value, 6) END AS value FROM (
  SELECT run_id, epoch, 'val_loss' AS metric, val_loss AS value FROM fx_history
  UNION ALL SELECT run_id, epoch, 'val_f1', val_f1 FROM fx_history) x""", "fx_history"), "S9")
def q_metric_log(spark, sf):
    return HS.metric_log(history(spark, sf), ["run_id", "epoch"], ["val_loss", "val_f1"]) \
        .withColumn("value", F.round(R.nan_to_null("value"), 6))
