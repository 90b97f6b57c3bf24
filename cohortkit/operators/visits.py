"""Follow-up filters and cohort counts.

Many follow-up thresholds are answered in one pass: each threshold becomes a
conditional aggregate of a single ``agg`` (one scan, partial aggregation),
and the one-row result is unpivoted to one row per threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.recode import nan_to_null

# Days per year as used by the two pipelines.
DAYS_PER_YEAR = 365
DAYS_PER_YEAR_JULIAN = 365.25


def followup_at_least(days: str | Column, years: float, inclusive: bool = True,
                      days_per_year: float = DAYS_PER_YEAR) -> Column:
    """Follow-up longer than ``years`` (strict or inclusive)."""
    d = F.col(days) if isinstance(days, str) else days
    cut = F.lit(years * days_per_year)
    return d >= cut if inclusive else d > cut


def events_only(df: DataFrame, label: str = "Eskd") -> DataFrame:
    """rows with the event."""
    return df.where(F.col(label) == 1)


def cohort_stats(df: DataFrame, label: str = "Eskd", days: str = "dateAssess") -> DataFrame:
    """A4: patients, events, share, mean follow-up (years), value ranges."""
    n = F.count(F.lit(1))
    ev = F.sum(label)
    return df.agg(
        n.alias("n_patients"),
        ev.cast("long").alias("n_events"),
        F.round(F.coalesce(F.try_divide(100.0 * ev, n), F.lit(0.0)), 6).alias("pct_events"),
        F.round(F.avg(days) / 365.0, 6).alias("mean_followup_years"),
        F.round(F.min("Creatinine"), 6).alias("min_creatinine"),
        F.round(F.max("Creatinine"), 6).alias("max_creatinine"),
        F.round(F.min("Proteinuria"), 6).alias("min_proteinuria"),
        F.round(F.max("Proteinuria"), 6).alias("max_proteinuria"),
    )


def event_share(df: DataFrame, label: str = "Eskd") -> DataFrame:
    """A2: events, total, percent (0 when empty)."""
    n = F.count(F.lit(1))
    ev = F.coalesce(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.lit(0)).cast("long")
    return df.agg(
        ev.alias("n_events"), n.alias("n_total"),
        F.round(F.coalesce(F.try_divide(100.0 * ev, n), F.lit(0.0)), 6).alias("pct_events"))


def events_by_followup(df: DataFrame, years: Sequence[int], label: str = "Eskd",
                       days: str = "dateAssess") -> DataFrame:
    """A3: events with follow-up beyond each threshold, strict (F1) and
    inclusive (F2), plus the inclusive patient count.  One scan."""
    aggs = []
    for y in years:
        aggs += [
            F.coalesce(F.sum(F.when(followup_at_least(days, y, False), F.col(label))), F.lit(0))
             .cast("long").alias(f"s{y}"),
            F.coalesce(F.sum(F.when(followup_at_least(days, y, True), F.col(label))), F.lit(0))
             .cast("long").alias(f"i{y}"),
            F.count(F.when(followup_at_least(days, y, True), 1)).alias(f"p{y}"),
        ]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(y).alias("years"), F.col(f"s{y}").alias("events_strict"),
                              F.col(f"i{y}").alias("events_inclusive"),
                              F.col(f"p{y}").alias("patients_inclusive")) for y in years])
    return one.select(F.inline(rows))


def column_max(df: DataFrame, *cols: str) -> DataFrame:
    """A10: one-row maxima (unit detection); NaN does not count."""
    value = {f.name: nan_to_null(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields}
    return df.agg(*[F.max(value[c]).alias(f"max_{c}") for c in cols])
