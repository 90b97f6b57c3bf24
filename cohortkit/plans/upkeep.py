"""Cohort and feature moments kept up to date while sheets arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import harmonise as H
from cohortkit.operators import moments as MO
from cohortkit.operators import splits as SP
from cohortkit.operators import upkeep as UP
from cohortkit.plans.cohort import site_a, site_b
from cohortkit.plans.features import FEATS, stored_split_features
from cohortkit.plans.oracle import COHORT_COLS, with_ctes
from cohortkit.plans.registry import query
from cohortkit.session import cut_lineage

#: The stand-in sheets arrive in so many parts, dealt by the row id.
ARRIVALS = 3
#: Patients with less follow-up than this withdraw.
WITHDRAWN_DAYS = 400


def arrivals(spark: SparkSession, sf: str, mode: str) -> list[DataFrame]:
    """The cleaned visits of both sites as sheets that arrive one after another."""
    visits = H.stack_sites(site_a(spark, sf, mode), site_b(spark, sf))
    visits = cut_lineage(visits.select(*H.COHORT_COLUMNS, "site_order", "row_id"), "arrivals")
    part = F.pmod(F.coalesce(F.col("row_id"), F.lit(0)), F.lit(ARRIVALS))
    return [visits.where(part == i) for i in range(ARRIVALS)]


def _kept(spark: SparkSession, sf: str, mode: str, **rules) -> DataFrame:
    """All arrivals appended, the runs compacted once in between."""
    parts = arrivals(spark, sf, mode)
    state = UP.create(parts[0], **rules)
    for i, part in enumerate(parts):
        UP.append(state, part)
        if i == 1:
            old, state = state, UP.compact(spark, state)
            UP.drop(spark, old)
    return UP.current(spark, state).select(*H.COHORT_COLUMNS)


@query("upkept_cohort_last", with_ctes("SELECT * FROM cohort_max", "cohort_max"), "W2,S6 kept up to date")
def q_last(spark, sf):
    return _kept(spark, sf, "max")


@query("upkept_cohort_first", with_ctes(f"""
SELECT {COHORT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY Code ORDER BY dateAssess, site_order, row_id) AS rn
  FROM visits_min WHERE Code IS NOT NULL AND dateAssess IS NOT NULL) t WHERE rn = 1""", "visits_min"),
       "W3,S6 kept up to date")
def q_first(spark, sf):
    return _kept(spark, sf, "min", rule="first")


@query("upkept_cohort_tail", with_ctes(f"""
SELECT {COHORT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY Code ORDER BY dateAssess DESC, site_order DESC, row_id DESC) AS rn
  FROM visits_max WHERE Code IS NOT NULL AND dateAssess IS NOT NULL) t WHERE rn = 1""", "visits_max"),
       "W5,S6 kept up to date")
def q_tail(spark, sf):
    return _kept(spark, sf, "max", ties="last")


def _won(where: str) -> str:
    return f"""(SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY Code ORDER BY dateAssess DESC, site_order, row_id) AS rn
  FROM visits_max WHERE Code IS NOT NULL AND dateAssess IS NOT NULL AND {where}) t WHERE rn = 1)"""


@query("upkept_changes", with_ctes(f"""
SELECT {", ".join("w." + c.strip() for c in COHORT_COLS.split(","))}, CASE WHEN o.Code IS NULL THEN 'new' ELSE 'replaced' END AS change
FROM {_won("true")} w LEFT JOIN {_won(f"coalesce(row_id, 0) % {ARRIVALS} <> {ARRIVALS - 1}")} o ON o.Code = w.Code
WHERE o.Code IS NULL OR o.site_order <> w.site_order OR o.row_id IS DISTINCT FROM w.row_id""", "visits_max"),
       "W2 (rows that an arrival alters)")
def q_changes(spark, sf):
    *before, last = arrivals(spark, sf, "max")
    state = UP.create(last)
    for part in before:
        UP.append(state, part)
    return UP.changes(spark, state, last).select(*H.COHORT_COLUMNS, "change")


def _long(st: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f"mean_{f}", 6).alias("mean"),
                              F.round(f"std_{f}", 6).alias("std")) for f in FEATS])
    return st.select("fold", "n_train", F.inline(rows))


@query("moments_after_withdrawal", with_ctes(" UNION ALL ".join(
    f"SELECT fold, count(*) AS n_train, '{f}' AS feature, round(avg({f}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({f}) <= 1e-12 * abs(avg({f})) THEN 1.0 ELSE stddev_pop({f}) END, 6) AS std "
    f"FROM feat WHERE is_test = 0 AND (dateAssess >= {WITHDRAWN_DAYS} OR dateAssess IS NULL) GROUP BY fold" for f in FEATS), "feat"),
       "A7 (stored moments: added, then withdrawn)")
def q_withdrawal(spark, sf):
    """Moments of three arrivals are merged, withdrawn patients subtracted, cancelled ones read again."""
    rows = SP.train_rows(stored_split_features(spark, sf)).select("Code", "fold", "dateAssess", *FEATS)
    part = F.pmod(F.xxhash64("Code"), F.lit(ARRIVALS))
    stored = MO.scan(rows.where(part == 0), FEATS, ["fold"])
    for i in range(1, ARRIVALS):
        stored = cut_lineage(MO.add(stored, MO.scan(rows.where(part == i), FEATS, ["fold"]), ["fold"]), "moments")
    gone = F.col("dateAssess") < WITHDRAWN_DAYS
    less = cut_lineage(MO.remove(stored, MO.scan(rows.where(gone), FEATS, ["fold"]), ["fold"]), "moments")
    left = rows.where(~F.coalesce(gone, F.lit(False)))
    return _long(MO.scaler(MO.settle(less, left, FEATS, ["fold"]), FEATS, ["fold"]))
