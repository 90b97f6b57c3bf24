"""Feature, scaling and preprocessing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions import recode as R
from cohortkit.operators import features as FT
from cohortkit.operators import splits as SP
from cohortkit.operators import visits as V
from cohortkit.plans import splits as _splits  # noqa: F401  (defines the strat CTE)
from cohortkit.plans.cohort import cohort
from cohortkit.plans.oracle import CTE, _DEPS, with_ctes
from cohortkit.plans.registry import query
from cohortkit.session import cut_lineage
from cohortkit.sources import fixtures as fx
from cohortkit.sources.tables import require_columns

SEED = 42
K = 10
FEATS = FT.FEATURES

# Therapy columns and feature list of the merged-CSV pipeline.
PR_THERAPY = ["RAS blockers", "Immunotherapies", "fish oil", "Tonsillectomy"]
PR_NUMERIC = ["age", "systolic", "Diastolic", "creat_mg_dl", "Uprot", "M", "E", "S", "T", "C"]


def features(spark: SparkSession, sf: str) -> DataFrame:
    return FT.feature_frame(cohort(spark, sf, "max"))


def split_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features with split and fold."""
    return SP.stratified_split(features(spark, sf), "Code", "label", SEED, 0.2, K)


def stored_split_features(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a table in the shared folder, for plans that read it more than once."""
    return cut_lineage(split_features(spark, sf), "features")


def fold_stats(spark: SparkSession, sf: str, split: DataFrame | None = None) -> DataFrame:
    s = split if split is not None else split_features(spark, sf)
    return FT.fold_scalers(SP.train_rows(s), FEATS, "fold", K)


def _r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


CTE["ff"] = """
SELECT Code, CAST(coalesce(Eskd, 0) AS INTEGER) AS label, dateAssess,
       coalesce(CASE Gender WHEN 'M' THEN 0.0 WHEN 'F' THEN 1.0 ELSE TRY_CAST(Gender AS DOUBLE) END, 0.0) AS Gender,
       coalesce(CAST(Age AS DOUBLE), 0.0) AS Age, coalesce(CAST(Hypertension AS DOUBLE), 0.0) AS Hypertension,
       coalesce(CAST(M AS DOUBLE), 0.0) AS M, coalesce(CAST(E AS DOUBLE), 0.0) AS E, coalesce(CAST(S AS DOUBLE), 0.0) AS S,
       coalesce(CAST(T AS DOUBLE), 0.0) AS T, coalesce(CAST(C AS DOUBLE), 0.0) AS C,
       coalesce(Proteinuria, 0.0) AS Proteinuria, coalesce(Creatinine, 0.0) AS Creatinine,
       coalesce(CAST(greatest(Antihypertensive, Immunosuppressants, FishOil) AS DOUBLE), 0.0) AS Therapy
FROM cohort_max"""
_DEPS["ff"] = ["cohort_max"]
CTE["feat"] = "SELECT f.*, s.is_test, s.fold FROM ff f JOIN strat s USING (Code)"
_DEPS["feat"] = ["ff", "strat"]
CTE["fstats"] = ("SELECT t.fold, count(*) AS n_train, " + ", ".join(
    f"avg(x.{f}) AS m_{f}, CASE WHEN stddev_pop(x.{f}) <= 1e-12 * abs(avg(x.{f})) THEN 1.0 ELSE stddev_pop(x.{f}) END AS s_{f}"
    for f in FEATS) + """
FROM (SELECT DISTINCT fold FROM feat WHERE is_test = 0) t JOIN feat x ON x.is_test = 0 AND x.fold <> t.fold
GROUP BY t.fold""")
_DEPS["fstats"] = ["feat"]


@query("features_filled", with_ctes("SELECT Code, label, dateAssess, " + ", ".join(
    f"round({f}, 6) AS {f}" for f in FEATS) + " FROM ff", "ff"), "P5,P17,P19")
def q_features(spark, sf):
    return features(spark, sf).select("Code", "label", "dateAssess", *_r6(FEATS))


@query("scaler_stats_by_fold", with_ctes(" UNION ALL ".join(
    f"SELECT fold, n_train, '{f}' AS feature, round(m_{f}, 6) AS mean, round(s_{f}, 6) AS std FROM fstats"
    for f in FEATS), "fstats"), "A7")
def q_scaler_stats(spark, sf):
    st = fold_stats(spark, sf, stored_split_features(spark, sf))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f"mean_{f}", 6).alias("mean"),
                              F.round(f"std_{f}", 6).alias("std")) for f in FEATS])
    return st.select("fold", "n_train", F.inline(rows))


@query("scaled_features", with_ctes("SELECT x.Code, x.fold, " + ", ".join(
    f"round((x.{f} - s.m_{f}) / s.s_{f}, 6) AS {f}" for f in FEATS)
    + " FROM feat x JOIN fstats s USING (fold) WHERE x.is_test = 0", "fstats"), "J5")
def q_scaled(spark, sf):
    s = stored_split_features(spark, sf)
    z = FT.scale(SP.train_rows(s).select("Code", "fold", *FEATS), fold_stats(spark, sf, s), FEATS)
    return z.select("Code", "fold", *_r6(FEATS))


@query("inverse_scaled", with_ctes("SELECT Code, fold, " + ", ".join(
    f"round({f}, 6) AS {f}" for f in FEATS) + " FROM feat WHERE is_test = 0", "feat"), "M13")
def q_inverse(spark, sf):
    s = stored_split_features(spark, sf)
    st = fold_stats(spark, sf, s)
    z = FT.scale(SP.train_rows(s).select("Code", "fold", *FEATS), st, FEATS)
    return FT.unscale(z, st, FEATS).select("Code", "fold", *_r6(FEATS))


@query("therapy_sum_flag", with_ctes("""
SELECT row_id, CAST(coalesce(TRY_CAST(ras_blockers AS DOUBLE), 0) + coalesce(TRY_CAST(Immunotherapies AS DOUBLE), 0)
                    + coalesce(TRY_CAST(fish_oil AS DOUBLE), 0) > 0 AS INTEGER) AS Therapy
FROM fx_site_b""", "fx_site_b"), "P18,S4")
def q_therapy_sum(spark, sf):
    b = fx.fx_site_b(spark, sf)
    return b.select("row_id", R.any_therapy_sum(b, PR_THERAPY).alias("Therapy"))


def complete_cases(raw: DataFrame) -> DataFrame:
    """Merged-CSV pipeline (PR): flags, numeric coercion, drop incomplete rows
    (P20), then sex M -> 1, F -> 0 (map, else NULL)."""
    require_columns(raw, PR_NUMERIC + ["SEX", "dateAssess", "outcome"], any_of=PR_THERAPY)
    x = raw.select(
        "row_id", "SEX", *[R.to_double(c).alias(c) for c in PR_NUMERIC],
        R.any_therapy_sum(raw, PR_THERAPY).alias("Therapy"),
        R.hypertension("systolic", "Diastolic").alias("Hypertension"),
        (F.col("dateAssess") / 365.25).alias("years_since_biopsy"), F.col("outcome"))
    x = x.na.drop(subset=["SEX", *PR_NUMERIC, "Therapy", "Hypertension", "years_since_biopsy", "outcome"])
    return x.withColumn("SEX", R.sex_to_number(x, "SEX", "M1F0").cast("int"))


@query("complete_cases", with_ctes("""
SELECT row_id, CASE SEX WHEN 'M' THEN 1 WHEN 'F' THEN 0 END AS SEX, age, systolic, Diastolic, creat_mg_dl, Uprot,
       M, E, S, T, C, Therapy, Hypertension, round(years_since_biopsy, 6) AS years_since_biopsy, outcome
FROM (SELECT row_id, SEX, CAST(age AS DOUBLE) AS age, TRY_CAST(systolic AS DOUBLE) AS systolic,
             TRY_CAST(Diastolic AS DOUBLE) AS Diastolic, TRY_CAST(creat_mg_dl AS DOUBLE) AS creat_mg_dl,
             TRY_CAST(Uprot AS DOUBLE) AS Uprot, CAST(M AS DOUBLE) AS M, CAST(E AS DOUBLE) AS E,
             CAST(S AS DOUBLE) AS S, CAST(T AS DOUBLE) AS T, CAST(C AS DOUBLE) AS C,
             CAST(coalesce(TRY_CAST(ras_blockers AS DOUBLE), 0) + coalesce(TRY_CAST(Immunotherapies AS DOUBLE), 0)
                  + coalesce(TRY_CAST(fish_oil AS DOUBLE), 0) > 0 AS INTEGER) AS Therapy,
             CAST(coalesce(TRY_CAST(systolic AS DOUBLE) >= 140, false) OR coalesce(TRY_CAST(Diastolic AS DOUBLE) >= 90, false)
                  AS INTEGER) AS Hypertension,
             dateAssess / 365.25 AS years_since_biopsy, outcome
      FROM fx_site_b) t
WHERE SEX IS NOT NULL AND systolic IS NOT NULL AND Diastolic IS NOT NULL AND creat_mg_dl IS NOT NULL
  AND Uprot IS NOT NULL AND outcome IS NOT NULL""", "fx_site_b"), "P9 (no treatment term),P18,P20,P5 (M1/F0)")
def q_complete_cases(spark, sf):
    x = complete_cases(fx.fx_site_b(spark, sf))
    return x.withColumn("years_since_biopsy", F.round("years_since_biopsy", 6))


_TARGET_SQL = """
SELECT Code, round(dateAssess / 365.25, 6) AS years,
       round(CASE WHEN Eskd = 1 THEN dateAssess / 365.25 END, 6) AS target
FROM cohort_max"""


def regression_target(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    c = FT.to_years(cohort(spark, sf, "max"), "dateAssess", unit, out="years")
    c = FT.event_time_target(c, "years", "Eskd", out="target")
    return c.select("Code", F.round("years", 6).alias("years"), F.round("target", 6).alias("target"))


@query("regression_target", with_ctes(_TARGET_SQL, "cohort_max"), "P22,P23")
def q_regression_target(spark, sf):
    return regression_target(spark, sf, "days")


@query("regression_target_auto", with_ctes(_TARGET_SQL, "cohort_max"), "P22 (unit from the column maximum)")
def q_regression_target_auto(spark, sf):
    return regression_target(spark, sf, "auto")


@query("column_maxima", with_ctes("""
SELECT max(dateAssess) AS max_dateAssess, max(Creatinine) AS max_Creatinine FROM cohort_max""", "cohort_max"), "A10")
def q_column_maxima(spark, sf):
    return V.column_max(cohort(spark, sf, "max"), "dateAssess", "Creatinine")


_NUM = ["Age", "dateAssess", "Hypertension", "M", "E", "S", "T", "C", "Proteinuria", "Creatinine", "Antihypertensive",
        "Immunosuppressants", "FishOil"]


@query("numeric_features", with_ctes("SELECT Code, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _NUM)
                                     + " FROM cohort_max", "cohort_max"), "P21")
def q_numeric_features(spark, sf):
    c = cohort(spark, sf, "max")
    return c.select("Code", *[F.round(F.col(x).cast("double"), 6).alias(x) for x in FT.numeric_columns(c, ["Code", "Eskd"])])


@query("sex_codes", with_ctes("""
SELECT row_id, CASE SEX WHEN 'M' THEN 1.0 WHEN 'F' THEN 2.0 ELSE TRY_CAST(SEX AS DOUBLE) END AS m1f2,
       CASE lower(SEX) WHEN 'm' THEN 0.0 WHEN 'f' THEN 1.0 ELSE TRY_CAST(SEX AS DOUBLE) END AS lower_m0f1
FROM fx_site_b""", "fx_site_b"), "P5 (M1/F2, m/f)")
def q_sex_codes(spark, sf):
    b = fx.fx_site_b(spark, sf)
    low = b.withColumn("SEX", F.lower("SEX"))
    return b.select("row_id", R.sex_to_number(b, "SEX", "M1F2").cast("double").alias("m1f2"),
                    R.sex_to_number(low, "SEX", "M0F1_any_case").cast("double").alias("lower_m0f1"))
