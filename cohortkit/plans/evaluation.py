"""Evaluation plan and metric queries.

scores(id, fold, label, prob, follow-up) -> thresholds -> per (fold,
threshold) confusion, rates, AUC -> fold summary.  One job for all folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import metrics as MT
from cohortkit.operators import sampling as SM
from cohortkit.operators import splits as SP
from cohortkit.operators import visits as V
from cohortkit.plans.oracle import CTE, _DEPS, with_ctes
from cohortkit.plans.registry import query
from cohortkit.sources import fixtures as fx

SEED = 42
K = 10
BATCH = 32
YEARS = (0, 5, 10)
RATE_COLS = ["accuracy", "precision", "recall", "f1", "auc"]


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows with a fold (plain k-fold in hash order)."""
    return SP.plain_split(fx.fx_scores(spark, sf), "id", SEED, 0.0, K).drop("is_test")


def per_fold_followup(spark: SparkSession, sf: str) -> DataFrame:
    return MT.metrics_by_followup(scores(spark, sf), "y", "prob", "fu_days", YEARS, by=["fold"])


def scored_batches(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.fx_scores(spark, sf)
    return SM.batches(s, "id", SEED, BATCH).withColumn("logit", MT.logit("prob"))


def regression_rows(spark: SparkSession, sf: str, clamp: bool) -> DataFrame:
    """Time-to-event rows: site B events, target in years; the stand-in
    prediction is a fixed linear score of age (optionally clamped, P27)."""
    b = V.events_only(fx.fx_site_b(spark, sf), "outcome")
    pred = F.col("age") / 5 - 5
    x = b.select("row_id", (F.col("dateAssess") / 365.25).alias("target"),
                 (MT.clamp(pred) if clamp else pred).alias("pred"))
    return SP.plain_split(x, "row_id", SEED, 0.0, K).drop("is_test")


_H = "md5(concat('{seed}|', CAST({key} AS VARCHAR)))"
CTE["scores"] = f"""
SELECT s.*, (row_number() OVER (ORDER BY {_H.format(seed=SEED, key='id')}, id) - 1) % {K} + 1 AS fold FROM fx_scores s"""
_DEPS["scores"] = ["fx_scores"]

CTE["followup"] = """
SELECT s.fold, t.years, s.y, s.prob FROM scores s JOIN (SELECT unnest([0, 5, 10]) AS years) t
  ON t.years = 0 OR s.fu_days >= t.years * 365"""
_DEPS["followup"] = ["scores"]


def _rates_sql(src: str, keys: str) -> str:
    return f"""
SELECT {keys}, tn, fp, fn, tp, tn + fp + fn + tp AS n,
       round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT {keys},
        count(CASE WHEN y = 0 AND prob <= 0.5 THEN 1 END) AS tn, count(CASE WHEN y = 0 AND prob > 0.5 THEN 1 END) AS fp,
        count(CASE WHEN y = 1 AND prob <= 0.5 THEN 1 END) AS fn, count(CASE WHEN y = 1 AND prob > 0.5 THEN 1 END) AS tp
      FROM {src} GROUP BY {keys}) c"""


def _auc_sql(src: str, keys: str) -> str:
    return f"""
SELECT {keys}, round(sum(pos * (nb + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY prob
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM (SELECT {keys}, prob, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg
            FROM {src} GROUP BY {keys}, prob) a) b
GROUP BY {keys}"""


CTE["per_fold_followup"] = f"""
SELECT r.*, a.auc FROM ({_rates_sql('followup', 'fold, years')}) r
LEFT JOIN ({_auc_sql('followup', 'fold, years')}) a USING (fold, years)"""
_DEPS["per_fold_followup"] = ["followup"]

CTE["sbatch"] = f"""
SELECT id, y, ln(prob / (1 - prob)) AS s,
       (row_number() OVER (ORDER BY {_H.format(seed=SEED, key='id')}, id) - 1) // {BATCH} AS batch_id
FROM fx_scores"""
_DEPS["sbatch"] = ["fx_scores"]


def _pair_loss_sql(variant: str) -> str:
    if variant == "softplus":
        agg = "greatest(avg(greatest(n.s - p.s, 0) + ln(1 + exp(-abs(n.s - p.s)))), 0)"
    else:
        agg = "least(greatest(1 - avg(1 / (1 + exp(-(p.s - n.s)))), 0), 1)"
    return f"""
SELECT c.batch_id, n, n_pos, n_neg, round(coalesce(m, 0), 6) AS loss
FROM (SELECT batch_id, count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS n_pos,
             count(CASE WHEN y = 0 THEN 1 END) AS n_neg FROM sbatch GROUP BY batch_id) c
LEFT JOIN (SELECT p.batch_id, {agg} AS m FROM sbatch p JOIN sbatch n
           ON p.batch_id = n.batch_id AND p.y = 1 AND n.y = 0 GROUP BY p.batch_id) l USING (batch_id)"""


CTE["pair_loss"] = _pair_loss_sql("softplus")
_DEPS["pair_loss"] = ["sbatch"]


def _reg_sql(clamp: bool) -> str:
    pred = "least(greatest(age / 5 - 5, 0.0), 10.0)" if clamp else "age / 5 - 5"
    return f"""
SELECT fold, count(*) AS n, round(avg(abs(pred - target)), 6) AS mae,
       round(avg((pred - target) * (pred - target)), 6) AS mse,
       round(sqrt(avg((pred - target) * (pred - target))), 6) AS rmse,
       round(1 - sum((pred - target) * (pred - target)) / nullif(sum((target - m) * (target - m)), 0), 6) AS r2
FROM (SELECT *, avg(target) OVER (PARTITION BY fold) AS m
      FROM (SELECT *, (row_number() OVER (ORDER BY {_H.format(seed=SEED, key='row_id')}, row_id) - 1) % {K} + 1 AS fold
            FROM (SELECT row_id, dateAssess / 365.25 AS target, {pred} AS pred FROM fx_site_b WHERE outcome = 1) r) f) g
GROUP BY fold"""


CTE["reg_clamped"] = _reg_sql(True)
_DEPS["reg_clamped"] = ["fx_site_b"]


@query("score_functions", with_ctes("""
SELECT id, round(1 / (1 + exp(-ln(prob / (1 - prob)))), 6) AS p_sigmoid,
       round(1 / (1 + exp(1 - 2 * prob)), 6) AS p_softmax1,
       round(1 / (1 + exp(1 - 2 * (1 / (1 + exp(1 - 2 * prob))))), 6) AS p_softmax2,
       CAST(prob > 0.5 AS INTEGER) AS pred_strict,
       CAST(1 / (1 + exp(1 - 2 * (1 / (1 + exp(1 - 2 * prob))))) >= 0.731 AS INTEGER) AS pred_keras
FROM fx_scores""", "fx_scores"), "P24,P25,P26")
def q_score_functions(spark, sf):
    s = fx.fx_scores(spark, sf)
    sm2 = MT.softmax2("prob", 2)
    return s.select("id", F.round(MT.sigmoid(MT.logit("prob")), 6).alias("p_sigmoid"),
                    F.round(MT.softmax2("prob", 1), 6).alias("p_softmax1"),
                    F.round(sm2, 6).alias("p_softmax2"),
                    MT.classify("prob").alias("pred_strict"),
                    MT.classify(sm2, MT.CUTOFF_KERAS, inclusive=True).alias("pred_keras"))


@query("confusion", with_ctes(f"SELECT fold, tn, fp, fn, tp FROM ({_rates_sql('scores', 'fold')}) x", "scores"), "M1")
def q_confusion(spark, sf):
    s = scores(spark, sf).withColumn("pred", MT.classify("prob"))
    return MT.confusion(s, "y", "pred", ["fold"])


@query("class_metrics", with_ctes(f"SELECT fold, tn, fp, fn, tp, accuracy, precision, recall, f1 FROM ({_rates_sql('scores', 'fold')}) x",
                                  "scores"), "M2")
def q_class_metrics(spark, sf):
    s = scores(spark, sf).withColumn("pred", MT.classify("prob"))
    return MT.rates(MT.confusion(s, "y", "pred", ["fold"]))


@query("auc_exact", with_ctes("""
SELECT p.fold, round(avg(CASE WHEN p.prob > n.prob THEN 1.0 WHEN p.prob = n.prob THEN 0.5 ELSE 0.0 END), 6) AS auc
FROM scores p JOIN scores n ON p.fold = n.fold AND p.y = 1 AND n.y = 0
GROUP BY p.fold""", "scores"), "M3 (oracle: brute force over all pairs)")
def q_auc(spark, sf):
    return MT.auc(scores(spark, sf), "y", "prob", ["fold"])


@query("metrics_by_followup", with_ctes("SELECT * FROM per_fold_followup", "per_fold_followup"), "M9,F2,M1-M3")
def q_metrics_followup(spark, sf):
    return per_fold_followup(spark, sf)


def summary_columns(metrics: list[str]) -> str:
    """SQL of the columns of ``fold_summary``."""
    return ", ".join(
        f"CAST(round(CAST(avg({m}) AS DECIMAL(38,10)), 6) AS DOUBLE) AS {m}_mean, "
        f"CAST(round(CAST(stddev_pop({m}) AS DECIMAL(38,10)), 6) AS DOUBLE) AS {m}_std, "
        f"concat_ws(' ± ', CAST(CAST(CAST(avg({m}) AS DECIMAL(38,10)) AS DECIMAL(38,4)) AS VARCHAR), "
        f"CAST(CAST(CAST(stddev_pop({m}) AS DECIMAL(38,10)) AS DECIMAL(38,4)) AS VARCHAR)) AS {m}_text" for m in metrics)


@query("fold_summary", with_ctes("SELECT years, count(*) AS n_folds, " + summary_columns(RATE_COLS)
                                 + " FROM per_fold_followup GROUP BY years", "per_fold_followup"), "M10")
def q_fold_summary(spark, sf):
    return MT.fold_summary(per_fold_followup(spark, sf), RATE_COLS, ["years"])


@query("confusion_keras", with_ctes("""
SELECT fold, count(CASE WHEN y = 0 AND pk = 0 THEN 1 END) AS tn, count(CASE WHEN y = 0 AND pk = 1 THEN 1 END) AS fp,
       count(CASE WHEN y = 1 AND pk = 0 THEN 1 END) AS fn, count(CASE WHEN y = 1 AND pk = 1 THEN 1 END) AS tp
FROM (SELECT fold, y, CAST(1 / (1 + exp(1 - 2 * (1 / (1 + exp(1 - 2 * prob))))) >= 0.731 AS INTEGER) AS pk FROM scores) s
GROUP BY fold""", "scores"), "P25,P26,M1 (double softmax, inclusive 0.731)")
def q_confusion_keras(spark, sf):
    s = scores(spark, sf).withColumn("pred", MT.classify(MT.softmax2("prob", 2), MT.CUTOFF_KERAS, inclusive=True))
    return MT.confusion(s, "y", "pred", ["fold"])


@query("proxy_auc_loss", with_ctes("SELECT * FROM pair_loss", "pair_loss"), "J4,M4")
def q_proxy_loss(spark, sf):
    return MT.pair_loss_per_batch(scored_batches(spark, sf), "y", "logit", variant="softplus") \
        .select("batch_id", F.col("n").cast("long").alias("n"), F.col("n_pos").cast("long").alias("n_pos"),
                F.col("n_neg").cast("long").alias("n_neg"), "loss")


@query("proxy_auc_sigmoid", with_ctes(_pair_loss_sql("sigmoid"), "sbatch"), "M5")
def q_proxy_sigmoid(spark, sf):
    return MT.pair_loss_per_batch(scored_batches(spark, sf), "y", "logit", variant="sigmoid") \
        .select("batch_id", F.col("n").cast("long").alias("n"), F.col("n_pos").cast("long").alias("n_pos"),
                F.col("n_neg").cast("long").alias("n_neg"), "loss")


@query("weighted_mean_loss", with_ctes("""
SELECT CAST(round(CAST(sum(loss * n) / sum(n) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_loss FROM pair_loss""",
                                        "pair_loss"), "M8")
def q_weighted_mean(spark, sf):
    per = MT.pair_loss_per_batch(scored_batches(spark, sf), "y", "logit")
    return MT.weighted_mean(per, "loss", "n")


@query("weighted_bce", with_ctes("""
SELECT fold, round(avg(pw * y * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) + (1 - y) * (greatest(x, 0) + ln(1 + exp(-abs(x))))), 6) AS bce,
       count(*) AS n
FROM (SELECT s.fold, s.y, ln(s.prob / (1 - s.prob)) AS x, w.pw FROM scores s JOIN
      (SELECT fold, CAST(count(CASE WHEN y = 0 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN y = 1 THEN 1 END), 0) AS pw
       FROM scores GROUP BY fold) w USING (fold)) t
GROUP BY fold""", "scores"), "M6,A5")
def q_weighted_bce(spark, sf):
    return MT.weighted_bce(scores(spark, sf).withColumn("logit", MT.logit("prob")), "y", "logit", by=["fold"])


@query("regression_errors", with_ctes(_reg_sql(False), "fx_site_b"), "M7,F4")
def q_regression(spark, sf):
    return MT.regression_errors(regression_rows(spark, sf, False), "target", "pred", ["fold"])


@query("clamped_errors", with_ctes("SELECT * FROM reg_clamped", "reg_clamped"), "P27,M7")
def q_clamped(spark, sf):
    return MT.regression_errors(regression_rows(spark, sf, True), "target", "pred", ["fold"])


@query("cv_summary", with_ctes("""
SELECT CAST(round(CAST(avg(mae) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_mae, CAST(round(CAST(stddev_pop(mae) AS DECIMAL(38,10)), 6) AS DOUBLE) AS std_mae, CAST(round(CAST(avg(rmse) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_rmse, CAST(round(CAST(stddev_pop(rmse) AS DECIMAL(38,10)), 6) AS DOUBLE) AS std_rmse, CAST(round(CAST(avg(r2) AS DECIMAL(38,10)), 6) AS DOUBLE) AS mean_r2, CAST(round(CAST(stddev_pop(r2) AS DECIMAL(38,10)), 6) AS DOUBLE) AS std_r2,
       string_agg(printf('best_model_fold_%d_results.json', fold), ',' ORDER BY fold) AS fold_result_files
FROM reg_clamped""", "reg_clamped"), "M11")
def q_cv_summary(spark, sf):
    per = MT.regression_errors(regression_rows(spark, sf, True), "target", "pred", ["fold"])
    files = F.transform(F.array_sort(F.collect_list(F.struct("fold", F.format_string(
        "best_model_fold_%d_results.json", F.col("fold")).alias("f")))), lambda e: e["f"])
    return per.agg(*[x for m in ("mae", "rmse", "r2") for x in (
        MT.round_exact(F.avg(m)).alias(f"mean_{m}"), MT.round_exact(F.stddev_pop(m)).alias(f"std_{m}"))],
        F.concat_ws(",", files).alias("fold_result_files"))


@query("event_share", with_ctes("""
SELECT count(CASE WHEN outcome = 1 THEN 1 END) AS n_events, count(*) AS n_total,
       round(coalesce(100.0 * count(CASE WHEN outcome = 1 THEN 1 END) / nullif(count(*), 0), 0), 6) AS pct_events
FROM fx_site_b""", "fx_site_b"), "A2")
def q_event_share(spark, sf):
    return V.event_share(fx.fx_site_b(spark, sf), "outcome")

