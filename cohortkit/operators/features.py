"""Feature preparation and fold-wise scaling.

The scaler uses the population standard deviation (zero -> 1), like the
reference's scaler and unlike ``pyspark.ml.feature.StandardScaler`` (sample
std, 0 for constant columns).  Training statistics for every fold come from
one pass: per-fold moments (count, mean, centred M2) are computed once, and
each fold's training statistics are merged from the other folds' moments
with the pairwise (Chan) update, on a table of k x (k - 1) rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions import recode as R

# Feature order of the classifier (11 inputs).
FEATURES = ["Gender", "Age", "Hypertension", "M", "E", "S", "T", "C", "Proteinuria", "Creatinine", "Therapy"]
THERAPY_COLUMNS = ["Antihypertensive", "Immunosuppressants", "FishOil"]
# A spread this small against the mean is rounding noise of a constant column.
STD_FLOOR = 1e-12


def feature_frame(cohort: DataFrame, key: str = "Code", label: str = "Eskd", sex_encoding: str = "M0F1",
                  label_policy: str = "zero", keep: Sequence[str] = ("dateAssess",)) -> DataFrame:
    """Cohort -> (key, label, kept columns, 11 numeric features).

    P5 sex to number, P17 any-therapy = row max of the three flags, P19
    missing / NaN / Inf -> 0 in features.  ``label_policy='zero'`` turns a
    missing label into 0 (reference training scripts); ``'drop'`` drops the
    row instead.
    """
    x = cohort
    if label_policy == "drop":
        x = x.where(F.col(label).isNotNull())
    cols = {
        "Gender": R.sex_to_number(x, "Gender", sex_encoding),
        "Therapy": R.any_therapy_max(*THERAPY_COLUMNS),
    }
    feats = [R.fill_invalid(cols.get(f, F.col(f)), 0.0).alias(f) for f in FEATURES]
    y = R.fill_invalid(F.col(label), 0.0).cast("int").alias("label")
    return x.select(key, y, *keep, *feats)


def fit_moments(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A7 building block: count, mean and centred M2 per group, one pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        aggs += [F.avg(f).alias(f"mu_{f}"), (F.var_pop(f) * F.count(F.lit(1))).alias(f"m2_{f}")]
    return df.groupBy(*by).agg(*aggs)


def _finish(st: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    out = [*by, F.col("_n").alias("n_train")]
    for f in features:
        sd = F.sqrt(F.col(f"m2_{f}") / F.col("_n"))
        out += [F.col(f"mu_{f}").alias(f"mean_{f}"),
                F.when(sd <= STD_FLOOR * F.abs(F.col(f"mu_{f}")), F.lit(1.0)).otherwise(sd).alias(f"std_{f}")]
    return st.select(*out)


def fit_scaler(df: DataFrame, features: Sequence[str] = FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std (0 -> 1) of each feature, per group."""
    return _finish(fit_moments(df, features, by), features, by)


def fold_scalers(train: DataFrame, features: Sequence[str] = FEATURES, fold: str = "fold", k: int = 10) -> DataFrame:
    """A7 for all folds at once: the statistics of fold f are those of the
    training rows outside fold f (what the fold's model is fitted on)."""
    per = fit_moments(train, features, [fold])
    # k rows of moments in one array: the rows are read and aggregated once
    row = F.struct(F.col(fold).cast("long").alias("f"), F.col("_n").alias("n"),
                   *[F.col(c) for f in features for c in (f"mu_{f}", f"m2_{f}")])
    all_ = per.where(F.col(fold).between(1, k)).agg(F.collect_list(row).alias("_r"))
    each = all_.select(F.explode("_r.f").alias(fold), "_r").withColumn("_r", F.filter("_r", lambda r: r["f"] != F.col(fold)))

    def total(value: Callable[[Column], Column]) -> Column:
        return F.aggregate("_r", F.lit(0.0), lambda a, r: a + value(r))

    each = each.where(F.size("_r") > 0).withColumn("_n", total(lambda r: r["n"]).cast("long"))
    each = each.withColumns({f"mu_{f}": total(lambda r, f=f: r["n"] * r[f"mu_{f}"]) / F.col("_n") for f in features})
    each = each.withColumns({f"m2_{f}": total(lambda r, f=f: r[f"m2_{f}"] + r["n"] * (r[f"mu_{f}"] - F.col(f"mu_{f}")) ** 2)
                             for f in features})
    return _finish(each, features, [fold])


def scale(df: DataFrame, stats: DataFrame, features: Sequence[str] = FEATURES, on: Sequence[str] = ("fold",)) -> DataFrame:
    """z = (x - mean) / std with the matching statistics row.

    ``stats`` has one row per fold by construction, so it is sent to the rows
    and no task gets a whole fold.  With
    ``on=()`` the single statistics row is a fitted model's parameters
    (2 x d numbers); they are read once and applied as literals.
    """
    keep = [c for c in df.columns if c not in features]
    if not on:
        r = stats.first()
        return df.select(*keep, *[((F.col(f) - F.lit(r[f"mean_{f}"])) / F.lit(r[f"std_{f}"])).alias(f)
                                  for f in features])
    j = df.join(F.broadcast(stats), list(on))
    return j.select(*keep, *[((F.col(f) - F.col(f"mean_{f}")) / F.col(f"std_{f}")).alias(f) for f in features])


def unscale(df: DataFrame, stats: DataFrame, features: Sequence[str] = FEATURES, on: Sequence[str] = ("fold",)) -> DataFrame:
    """x = z * std + mean."""
    j = df.join(F.broadcast(stats), list(on))
    keep = [c for c in df.columns if c not in features]
    return j.select(*keep, *[(F.col(f) * F.col(f"std_{f}") + F.col(f"mean_{f}")).alias(f) for f in features])


def to_years(df: DataFrame, days: str, unit: str = "auto", out: str | None = None,
             days_per_year: float = 365.25, auto_cutoff: float = 50) -> DataFrame:
    """Day counts to years.  ``unit='auto'`` converts when the column
    maximum exceeds ``auto_cutoff``; the maximum is a scalar subquery of the
    plan, so that building it starts no job."""
    out = out or days
    v = R.to_double(days)
    if unit == "auto":
        largest = df.agg(F.max(v)).scalar()
        return df.withColumn(out, v / F.when(largest > auto_cutoff, F.lit(days_per_year)).otherwise(F.lit(1.0)))
    return df.withColumn(out, v / days_per_year if unit == "days" else v)


def event_time_target(df: DataFrame, years: str, label: str = "Eskd", out: str = "TimeToESKD_years") -> DataFrame:
    """Time-to-event target = follow-up years where the event happened."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.col(years)))


def numeric_columns(df: DataFrame, drop: Sequence[str]) -> list[str]:
    """Numeric columns only, without the listed ones (key always dropped)."""
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in drop]
