"""Cohort build plan and its registered queries.

read sheets -> harmonise per site -> stack -> one row per patient -> stats.
One lazy plan; the shuffles are the per-patient reduction and the forward
fill's bucket carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import harmonise as H
from cohortkit.operators import visits as V
from cohortkit.plans.oracle import COHORT_COLS, with_ctes
from cohortkit.plans.registry import query
from cohortkit.sources import fixtures as fx

SITE_OUT = ["VALIGA_CODE", "row_id", "Gender", "Age", "dateAssess", "Hypertension", "M", "E", "S", "T", "C",
            "Proteinuria", "Creatinine", "Antihypertensive", "Immunosuppressants", "FishOil", "Eskd", "site"]


def site_a(spark: SparkSession, sf: str, mode: str = "max", scope: str = "table") -> DataFrame:
    return H.clean_site_a(fx.fx_site_a(spark, sf), mode=mode, ffill_scope=scope)


def site_b(spark: SparkSession, sf: str, scope: str = "table") -> DataFrame:
    return H.clean_site_b(fx.fx_site_b(spark, sf), ffill_scope=scope)


def cohort(spark: SparkSession, sf: str, mode: str = "max") -> DataFrame:
    """The cohort every downstream plan starts from (last visit per patient)."""
    return H.build_cohort(site_a(spark, sf, mode), site_b(spark, sf), mode=mode)


@query("site_a_clean", with_ctes("SELECT * FROM site_a_max", "site_a_max"), "S4,P1-P16,W1")
def q_site_a_clean(spark, sf):
    return site_a(spark, sf, "max").select(*SITE_OUT)


@query("site_a_clean_min", with_ctes("SELECT * FROM site_a_min", "site_a_min"), "P1,P2,P16 (baseline columns)")
def q_site_a_clean_min(spark, sf):
    return site_a(spark, sf, "min").select(*SITE_OUT)


@query("site_b_clean", with_ctes("SELECT * FROM site_b", "site_b"), "P4,P6,P9,P11,P13,P14,W1")
def q_site_b_clean(spark, sf):
    return site_b(spark, sf).select(*SITE_OUT)


@query("proteinuria_ffill_entity",
       with_ctes("SELECT VALIGA_CODE, row_id, Proteinuria FROM site_a_max_entity", "site_a_max_entity"),
       "W1 scope=entity")
def q_ffill_entity(spark, sf):
    return site_a(spark, sf, "max", scope="entity").select("VALIGA_CODE", "row_id", "Proteinuria")


@query("proteinuria_ffill_table",
       with_ctes("SELECT VALIGA_CODE, row_id, Proteinuria FROM site_b", "site_b"), "W1 scope=table")
def q_ffill_table(spark, sf):
    return site_b(spark, sf).select("VALIGA_CODE", "row_id", "Proteinuria")


@query("cohort_last", with_ctes("SELECT * FROM cohort_max", "cohort_max"), "U1,W2,P15")
def q_cohort_last(spark, sf):
    return cohort(spark, sf, "max")


@query("cohort_min_mode", with_ctes("SELECT * FROM cohort_min", "cohort_min"), "W3,W4,U1")
def q_cohort_min(spark, sf):
    return cohort(spark, sf, "min")


@query("cohort_first", with_ctes(f"""
SELECT {COHORT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY Code ORDER BY dateAssess, site_order, row_id) AS rn
  FROM visits_min WHERE Code IS NOT NULL AND dateAssess IS NOT NULL) t WHERE rn = 1""", "visits_min"),
       "W3 (first visit over both sites)")
def q_cohort_first(spark, sf):
    x = H.stack_sites(site_a(spark, sf, "min"), site_b(spark, sf), round_age=True)
    return H.one_row_per_entity(x, rule="first", columns=H.COHORT_COLUMNS[1:]).select(*H.COHORT_COLUMNS)


@query("cohort_latest_tail", with_ctes(f"""
SELECT {COHORT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY Code ORDER BY dateAssess DESC, site_order DESC, row_id DESC) AS rn
  FROM visits_max WHERE Code IS NOT NULL AND dateAssess IS NOT NULL) t WHERE rn = 1""", "visits_max"),
       "W5 (sort + tail(1): last row wins ties)")
def q_cohort_latest_tail(spark, sf):
    x = H.stack_sites(site_a(spark, sf, "max"), site_b(spark, sf), round_age=True)
    return (H.one_row_per_entity(x, rule="last", ties="last", columns=H.COHORT_COLUMNS[1:])
            .select(*H.COHORT_COLUMNS))


@query("cohort_stats", with_ctes("""
SELECT count(*) AS n_patients, CAST(sum(Eskd) AS BIGINT) AS n_events,
       round(CAST(coalesce(100.0 * sum(Eskd) / nullif(count(*), 0), 0) AS DOUBLE), 6) AS pct_events,
       round(avg(dateAssess) / 365.0, 6) AS mean_followup_years,
       round(min(Creatinine), 6) AS min_creatinine, round(max(Creatinine), 6) AS max_creatinine,
       round(min(Proteinuria), 6) AS min_proteinuria, round(max(Proteinuria), 6) AS max_proteinuria
FROM cohort_max""", "cohort_max"), "A4")
def q_cohort_stats(spark, sf):
    return V.cohort_stats(cohort(spark, sf, "max"))


@query("event_counts_by_followup", with_ctes("""
SELECT t.years AS years,
       CAST(coalesce(sum(CASE WHEN c.dateAssess > t.years * 365 THEN c.Eskd END), 0) AS BIGINT) AS events_strict,
       CAST(coalesce(sum(CASE WHEN c.dateAssess >= t.years * 365 THEN c.Eskd END), 0) AS BIGINT) AS events_inclusive,
       CAST(count(CASE WHEN c.dateAssess >= t.years * 365 THEN 1 END) AS BIGINT) AS patients_inclusive
FROM cohort_max c, (SELECT unnest([0, 5, 10]) AS years) t
GROUP BY t.years""", "cohort_max"), "A3,F1,F2")
def q_event_counts(spark, sf):
    return V.events_by_followup(cohort(spark, sf, "max"), [0, 5, 10])


@query("followup_julian_years", with_ctes("""
SELECT Code, round(dateAssess / 365.25, 6) AS years, CAST(dateAssess >= 10 * 365.25 AS INTEGER) AS at_least_10
FROM cohort_max WHERE dateAssess >= 5 * 365.25""", "cohort_max"), "F3,P22 (365.25 days a year)")
def q_followup_julian(spark, sf):
    c = cohort(spark, sf, "max").where(V.followup_at_least("dateAssess", 5, True, V.DAYS_PER_YEAR_JULIAN))
    ten = V.followup_at_least("dateAssess", 10, True, V.DAYS_PER_YEAR_JULIAN)
    return c.select("Code", F.round(F.col("dateAssess") / V.DAYS_PER_YEAR_JULIAN, 6).alias("years"), ten.cast("int").alias("at_least_10"))
