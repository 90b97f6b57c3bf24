"""Stored moments of features that rows are added to and taken from.

A table of moments has one row per group and feature: the count of the group's
rows and of the feature's values, their mean, the centred sum of squares, and
a bound on the rounding error of that sum.  Tables merge by the pairwise update.  Rows that leave (a
withdrawn patient, a held-out fold) are subtracted the same way.  Subtraction
can cancel nearly all of a sum where few rows stay, and the means of a
near-constant column differ in their last digits only; the bound grows then,
and a row whose bound passes ``TOLERANCE`` of the sum is marked stale and read
again from the group's rows by :func:`settle`.  An ``origin`` near a feature's
values keeps the digits that such a column would lose: means are stored as
differences from it.

NULL values count nowhere.  NaN or infinite values make a feature's moments
NaN; they are stale after the next update.  A group that loses its
last row is gone.  Group keys may be NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.operators.features import STD_FLOOR

#: Unit of rounding, with room for the handful of operations of an update.
ROUNDING = 8 * 2.0 ** -53
#: Relative error of a sum of squares from which a group is read again.
TOLERANCE = 1e-9


def scan(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), origin: Mapping[str, float] | None = None) -> DataFrame:
    """Moments of the rows, per group and feature; ``origin`` has a value near those of a feature (else 0)."""
    at = {f: F.lit(float((origin or {}).get(f, 0.0))) for f in features}
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for f in features:
        x = F.col(f).cast("double") - at[f]
        aggs += [F.count(f).alias(f"n_{f}"), F.avg(x).alias(f"mu_{f}"), F.var_pop(x).alias(f"var_{f}")]
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), at[f].alias("origin"), F.col(f"n_{f}").alias("n"),
                               F.coalesce(f"mu_{f}", F.lit(0.0)).alias("mu"),
                               (F.coalesce(f"var_{f}", F.lit(0.0)) * F.col(f"n_{f}")).alias("m2")) for f in features))
    raw = df.groupBy(*by).agg(*aggs).where("n_rows > 0").select(*by, "n_rows", F.inline(cells))
    # What a pass over the rows loses: its own rounding, and that of the mean as it moves.
    err = ROUNDING * (F.col("m2") + F.abs("mu") * F.sqrt(F.col("n") * F.col("m2")))
    return raw.select(*by, "n_rows", "feature", "origin", "n", "mu", "m2", err.alias("err"), F.lit(False).alias("stale"))


def _pair(a: DataFrame, b: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Rows of two tables side by side, those of ``b`` with means from the origin of ``a``; NULL keys meet."""
    keys = [*by, "feature"]
    left = a.select(F.struct(*a.columns).alias("a"))
    right = b.select(F.struct(*b.columns).alias("b"))
    both = left.join(right, reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), how)
    own = [F.when(F.col("a").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in [*keys, "origin"]]
    nums = [F.coalesce(f"{t}.{c}", F.lit(0)).alias(f"{t}_{c}") for t in "ab" for c in ("n_rows", "n", "m2", "err")]
    shift = F.col("b.origin") - F.coalesce("a.origin", "b.origin")
    return both.select(*own, *nums, F.coalesce("a.mu", F.lit(0.0)).alias("a_mu"), F.coalesce(F.col("b.mu") + shift, F.lit(0.0)).alias("b_mu"),
                       (F.coalesce("a.stale", F.lit(False)) | F.coalesce("b.stale", F.lit(False))).alias("was"))


def _doubt(t: str) -> Column:
    """Rounding error of a mean of n values, which Spark sums up one after another."""
    return ROUNDING * F.sqrt(f"{t}_n") * F.abs(f"{t}_mu")


def _update(pairs: DataFrame, by: Sequence[str], sign: int) -> DataFrame:
    """The pairwise update (sign 1), or backwards (-1); ``d``: distance of the means, ``w``: its weight."""
    touched = (F.col("a_n") > 0) & (F.col("b_n") > 0) if sign > 0 else F.col("b_n") > 0
    x = pairs.withColumns({"n_rows": F.col("a_n_rows") + sign * F.col("b_n_rows"), "n": F.col("a_n") + sign * F.col("b_n"),
                           "met": touched, "d": F.when(touched, F.col("b_mu") - F.col("a_mu")).otherwise(0.0)})
    x = x.withColumn("w", F.when(F.col("n") > 0, F.col("a_n") * F.col("b_n") / F.col("n")).otherwise(0.0))
    x = x.withColumn("spread", F.col("w") * F.col("d") * F.col("d"))
    alone = F.when(F.col("a_n") == 0, F.col("b_mu")) if sign > 0 else F.when(F.col("n") <= 0, F.lit(0.0))
    x = x.withColumns({
        "mu": alone.otherwise(F.when(F.col("met"), F.col("a_mu") + sign * F.col("d") * F.col("b_n") / F.col("n")).otherwise(F.col("a_mu"))),
        "m2": F.when(F.col("n") <= 0, 0.0).otherwise(F.col("a_m2") + sign * (F.col("b_m2") + F.col("spread"))),
        "err": F.col("a_err") + F.col("b_err") + F.when(F.col("met"), ROUNDING * (F.col("a_m2") + F.col("b_m2") + F.col("spread"))
                                                        + 2 * F.col("w") * F.abs("d") * (_doubt("a") + _doubt("b"))).otherwise(0.0),
        # Of a mean that cancelled, too, what is left must be exact.
        "slip": F.when(F.col("met") & (F.col("n") > 0), (_doubt("a") * F.col("a_n") + _doubt("b") * F.col("b_n")) / F.col("n")).otherwise(0.0)})
    size = F.sqrt(F.abs("m2") / F.greatest("n", F.lit(1))) + F.abs(F.col("mu") + F.col("origin"))
    lost = F.isnan("m2") | F.isnan("mu") | (F.col("m2") < 0) | (F.col("err") > TOLERANCE * F.col("m2")) | (F.col("slip") > TOLERANCE * size)
    stale = F.col("was") | (F.col("n_rows") < 0) | (F.col("n") < 0) | (F.col("met") & (F.col("n") > 0) & lost)
    return x.select(*by, "n_rows", "feature", "origin", "n", "mu", "m2", "err", stale.alias("stale"))


def add(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of the rows of both; stale where too many digits were lost."""
    return _update(_pair(a, b, by, "full"), by, 1)


def remove(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of the rows of ``a`` without those of ``b``; stale where too much was cancelled,
    and where ``b`` is no part of ``a``."""
    return _update(_pair(a, b, by, "left"), by, -1).where((F.col("n_rows") != 0) | F.col("stale"))


def settle(moments: DataFrame, rows: DataFrame, features: Sequence[str], by: Sequence[str] = (),
           origin: Mapping[str, float] | None = None) -> DataFrame:
    """The table with its stale moments read again from ``rows``, all rows that the table stands for.

    ``moments`` is used three times: store it first.  Groups without a row any
    more are gone.  Rows of groups that are not stale are not aggregated.
    """
    keys = [*by, "feature"]

    def marked(names: Sequence[str]) -> tuple[DataFrame, Column]:
        named = moments.where("stale").select(*(F.col(k).alias(f"_{k}") for k in names), F.lit(1).alias("_one"))
        return named, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names), F.col("_one") == 1)

    again = scan(rows.select(*by, *features).join(*marked(by), "left_semi"), features, by, origin).join(*marked(keys), "left_semi")
    return moments.where(~F.col("stale")).unionByName(again)


def scaler(moments: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A row per group with mean and population std of every feature, as ``features.scale`` takes them (no spread: 1)."""
    mean = F.when(F.col("n") > 0, F.col("origin") + F.col("mu"))
    sd = F.when(F.col("n") > 0, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n")))
    flat = moments.select(*by, "n_rows", "feature", mean.alias("mean"), F.when(sd <= STD_FLOOR * F.abs(mean), F.lit(1.0)).otherwise(sd).alias("std"))
    mine = [F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{c}_{f}") for f in features for c in ("mean", "std")]
    return flat.groupBy(*by).agg(F.max("n_rows").alias("n_train"), *mine).where("n_train is not null")
