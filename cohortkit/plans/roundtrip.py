"""Sources and sinks end to end: each query writes to the shared folder and
returns what it reads back (S1-S3, S5-S12)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortkit.functions import recode as R
from cohortkit.operators import features as FT
from cohortkit.operators import harmonise as H
from cohortkit.operators import metrics as MT
from cohortkit.operators import splits as SP
from cohortkit.operators import training as TR
from cohortkit.plans import evaluation as EV
from cohortkit.plans import history as HI
from cohortkit.plans import training as PT
from cohortkit.plans.cohort import SITE_OUT, cohort, site_a, site_b
from cohortkit.plans.features import stored_split_features
from cohortkit.plans.oracle import CTE, _DEPS, with_ctes
from cohortkit.plans.registry import query
from cohortkit.session import ensure_checkpoint_dir
from cohortkit.sources import fixtures as fx
from cohortkit.sources import sinks as SK
from cohortkit.sources import tables as ST

EXPORT_FOLD = 8  # the reference exports the samples of one fold


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/roundtrip-{uuid.uuid4().hex}/{name}"


@query("rt_site_tables", with_ctes("SELECT *, 'max' AS mode FROM site_a_max UNION ALL SELECT *, 'min' AS mode FROM site_a_min",
                                   "site_a_max", "site_a_min"), "S5,S1")
def q_site_tables(spark, sf):
    path = _folder(spark, "sites.parquet")
    for mode in ("max", "min"):
        SK.write_site_tables(site_a(spark, sf, mode).select(*SITE_OUT), path, mode)
    return ST.read_visits(spark, path).select(*SITE_OUT, "mode")


@query("rt_raw_sheet", with_ctes("SELECT * FROM site_b", "site_b"), "S1,S4 (raw sheet as CSV with its own headers)")
def q_raw_sheet(spark, sf):
    raw, path = fx.fx_site_b(spark, sf), _folder(spark, "site_b.csv")
    raw.write.option("header", True).csv(path)
    return H.clean_site_b(ST.read_visits(spark, path, raw.schema)).select(*SITE_OUT)


@query("rt_cohort", with_ctes("SELECT * FROM cohort_max", "cohort_max"), "S6,S3,W10")
def q_cohort(spark, sf):
    path = _folder(spark, "cohort")
    SK.write_cohort(cohort(spark, sf, "max"), path, sort=("Code",))
    return spark.read.parquet(path)


@query("rt_cohort_csv", with_ctes("SELECT * FROM cohort_max", "cohort_max"), "S2")
def q_cohort_csv(spark, sf):
    c, path = cohort(spark, sf, "max"), _folder(spark, "cohort.csv")
    c.write.option("header", True).csv(path)
    return ST.read_cohort_csv(spark, path, c.schema)


@query("rt_fold_results", with_ctes("""
SELECT fold, years, concat(CAST(tn AS VARCHAR), ' - ', CAST(fp AS VARCHAR)) AS cm_row0,
       concat(CAST(fn AS VARCHAR), ' - ', CAST(tp AS VARCHAR)) AS cm_row1,
       accuracy, precision, recall, f1, auc
FROM per_fold_followup""", "per_fold_followup"), "S7 (nested record)")
def q_fold_results(spark, sf):
    per, path = EV.per_fold_followup(spark, sf), _folder(spark, "results")
    SK.write_fold_results(per, path)
    r = spark.read.schema(SK.fold_result_records(per).schema).json(path)
    m = F.col("result").getField("Confusion Matrix").getField("matrix")
    names = {"years": "Years Threshold", "accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1 Score", "auc": "AUC"}
    return r.select("fold", m[0].alias("cm_row0"), m[1].alias("cm_row1"),
                    *[F.col("result").getField(v).alias(k) for k, v in names.items()])


@query("rt_summary", with_ctes("SELECT years, count(*) AS n_folds, " + EV.summary_columns(EV.RATE_COLS)
                               + " FROM per_fold_followup GROUP BY years", "per_fold_followup"), "S8")
def q_summary(spark, sf):
    s, path = MT.fold_summary(EV.per_fold_followup(spark, sf), EV.RATE_COLS, ["years"]), _folder(spark, "summary")
    SK.write_summary(s, path)
    return spark.read.schema(s.schema).json(path)


@query("rt_metric_log", with_ctes("""
SELECT run_id, epoch, metric, CASE WHEN NOT isnan(value) THEN round(value, 6) END AS value FROM (
  SELECT run_id, epoch, 'val_loss' AS metric, val_loss AS value FROM fx_history
  UNION ALL SELECT run_id, epoch, 'val_f1', val_f1 FROM fx_history) x""", "fx_history"), "S9 (appended twice, halves of the epochs)")
def q_metric_log(spark, sf):
    h, path = HI.history(spark, sf), _folder(spark, "log")
    for part in (F.col("epoch") <= HI.HALF, F.col("epoch") > HI.HALF):
        SK.append_metric_log(HI.HS.metric_log(h.where(part), ["run_id", "epoch"], ["val_loss", "val_f1"]), path)
    return SK.read_metric_log(spark, path).select("run_id", "epoch", "metric", F.round(R.nan_to_null("value"), 6).alias("value"))


def _best_half(cond: str) -> str:
    return f"""
SELECT fold, run_id, epoch, val_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY val_f1 DESC, run_id, epoch) AS rn
  FROM (SELECT *, CAST(run_id % {HI.K} + 1 AS BIGINT) AS fold FROM fx_history WHERE NOT isnan(val_f1) AND {cond}) h) t WHERE rn = 1"""


CTE["best_early"], CTE["best_late"] = _best_half(f"epoch <= {HI.HALF}"), _best_half(f"epoch > {HI.HALF}")
_DEPS["best_early"] = _DEPS["best_late"] = ["fx_history"]


@query("rt_best_model", with_ctes("""
SELECT coalesce(c.fold, s.fold) AS fold,
       CAST(CASE WHEN s.fold IS NULL OR c.val_f1 > s.val_f1 THEN c.run_id ELSE s.run_id END AS VARCHAR) AS run_id,
       CAST(CASE WHEN s.fold IS NULL OR c.val_f1 > s.val_f1 THEN c.epoch ELSE s.epoch END AS VARCHAR) AS best_epoch,
       CASE WHEN s.fold IS NULL OR c.val_f1 > s.val_f1 THEN c.val_f1 ELSE s.val_f1 END AS val_f1
FROM best_late c FULL JOIN best_early s ON c.fold = s.fold""", "best_early", "best_late"),
       "S10 (best-model record with configuration, written on improvement, read back as previous best)")
def q_best_model(spark, sf):
    h = HI.history(spark, sf)

    def records(part):
        best = HI.best_per_fold(h.where(part))
        return SK.best_records(best, ["best_epoch"], ["val_f1"])

    first = _folder(spark, "best")
    stored = SK.write_improved(records(F.col("epoch") <= HI.HALF), SK.read_previous_best(spark, first), "val_f1", first)
    second = SK.write_improved(records(F.col("epoch") > HI.HALF), stored, "val_f1", _folder(spark, "best"))
    return second.select("fold", "run_id", F.col("config")["best_epoch"].alias("best_epoch"), F.col("metrics")["val_f1"].alias("val_f1"))


MISSING = 3  # a fold whose artifact is not there


@query("rt_models", with_ctes(f"SELECT * FROM sat_eval WHERE fold <> {MISSING}", "sat_eval"), "S11 (a fold without an artifact is skipped)")
def q_models(spark, sf):
    models, _, test = PT.saturated_fit(spark, sf)
    path = _folder(spark, "models")
    for f, m in models.items():
        if f != MISSING:
            TR.save_model(m, f"{path}/fold={f}")
    return PT.evaluate(PT._exact(PT.test_scores(TR.load_fold_models(spark, path, PT.FOLDS), test)))


_SCORE = "0.04 * x.Age + 0.5 * x.Hypertension - 2"


@query("rt_samples", with_ctes(" UNION ALL ".join(f"""
SELECT x.fold, CAST(x.p > 0.5 AS INTEGER) AS prediction, '{f}' AS feature, round((x.{f} - s.m_{f}) / s.s_{f}, 6) AS scaled, x.{f} AS original,
       round(x.p, 6) AS probability
FROM (SELECT * REPLACE (CAST({EXPORT_FOLD} AS BIGINT) AS fold), 1 / (1 + exp(-({_SCORE}))) AS p FROM feat x WHERE is_test = 1) x JOIN fstats s ON s.fold = x.fold"""
                                                  for f in FT.FEATURES), "fstats"), "S12,P28,J5 (fixed linear score; the fold's scaler)")
def q_samples(spark, sf):
    s = stored_split_features(spark, sf)
    stats = FT.fold_scalers(SP.train_rows(s), FT.FEATURES, "fold", PT.K)
    test = SP.test_rows(s).withColumn("fold", F.lit(EXPORT_FOLD).cast("long"))
    prob = MT.sigmoid(0.04 * F.col("Age") + 0.5 * F.col("Hypertension") - 2)
    scored = test.select("fold", *FT.FEATURES, *[F.col(f).alias(f"o_{f}") for f in FT.FEATURES], prob.alias("prob"))
    scored = FT.scale(scored, stats, FT.FEATURES).withColumn("prediction", MT.classify("prob"))
    path = _folder(spark, "samples")
    SK.export_samples(SK.sample_records(scored, FT.FEATURES), path, folds=[EXPORT_FOLD])
    rec = "features_scaled map<string,double>, features_original map<string,double>, probability double, prediction int"
    back = spark.read.schema("record string, fold long, prediction int").json(path).withColumn("r", F.from_json("record", rec))
    return (back.select("fold", "prediction", "r", F.explode("r.features_scaled").alias("feature", "scaled"))
            .select("fold", "prediction", "feature", F.round("scaled", 6).alias("scaled"),
                    F.element_at("r.features_original", F.col("feature")).alias("original"), F.round("r.probability", 6).alias("probability")))
