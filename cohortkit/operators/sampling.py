"""Class rebalancing and batches.

Draws with replacement are deterministic: draw ``d`` picks a class uniformly
(every class has total weight 1 under inverse-frequency weights) and a row of
that class uniformly, both from md5 of ``(seed, d)``.  Rows are then fetched
with an equi-join on ``(class, rank within class)``, so the draw table and
the row table are both partitioned, and there are exactly N draws.  What the
reference repeats per fold is done for all folds at once, keyed by ``fold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.ranking import (bucket_counts, bucket_offsets, group_sizes, hash_rank, hash_uint60,
                                         join_rows, join_small, rank_rows, scaled)

# Classes up to which the class table may be broadcast (its rows are counted, not its input's).
MAX_CLASSES = 10_000


def in_training_of(counts: DataFrame, fold: str, k: int, n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Counts per own fold -> counts of the training part of each fold (all rows outside it).

    Works on the small table of counts: each own-fold row counts for the
    ``k - 1`` other folds.
    """
    others = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")), lambda t: t != F.col(fold))
    x = counts.select(*by, n, F.explode(others).alias("_t"))
    return x.groupBy(F.col("_t").alias(fold), *by).agg(F.sum(n).alias(n))


def training_parts(train: DataFrame, fold: str = "fold", k: int = 10) -> DataFrame:
    """Training rows of every fold's model: each row once per fold that trains on it, under that ``fold``."""
    others = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")), lambda t: t != F.col(fold))
    return train.withColumn(fold, F.explode(others))


def class_counts(df: DataFrame, label: str, fold: str | None = None, k: int = 10) -> DataFrame:
    """A1: rows per class and share of all rows; with ``fold``, of each fold's training part."""
    by = [fold] if fold else []
    c = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    c = in_training_of(c, fold, k, by=[label]) if fold else c
    tot = F.sum("n").over(Window.partitionBy(*by))  # one row per fold and class
    return c.withColumn("share", F.round(F.col("n") / tot, 6))


def class_weights(df: DataFrame, label: str, fold: str | None = None, k: int = 10) -> DataFrame:
    """Inverse-frequency weight per class, ``1 / n_class``; with ``fold``, in each fold's training part."""
    return class_counts(df, label, fold, k).drop("share").withColumn("weight", F.round(1.0 / F.col("n"), 9))


def with_sample_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """A6 as a row column (for ``weightCol`` of ``pyspark.ml`` estimators).

    Class sizes come from a grouped count.  Its rows are the classes; they
    are counted, and up to ``MAX_CLASSES`` of them are sent to the rows, so
    that no task gets a whole class.
    """
    w = df.groupBy(label).agg((1.0 / F.count(F.lit(1))).alias(out))
    if w.limit(MAX_CLASSES + 1).count() <= MAX_CLASSES:
        w = F.broadcast(w)
    return join_small(df, w, [label])


def pos_weight(df: DataFrame, label: str, fold: str | None = None, k: int = 10) -> DataFrame:
    """A5: negatives / positives (NULL when there is no positive); with ``fold``, of each fold's training part."""
    neg, pos = F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"), F.count(F.when(F.col(label) == 1, 1)).alias("n_pos")
    c = df.groupBy(*([fold] if fold else [])).agg(neg, pos)
    if fold:
        both = F.struct("n_neg", "n_pos")
        others = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long")), lambda t: t != F.col(fold))
        c = (c.select(both.alias("c"), F.explode(others).alias("_t")).groupBy(F.col("_t").alias(fold))
             .agg(F.sum("c.n_neg").alias("n_neg"), F.sum("c.n_pos").alias("n_pos")))
    return c.withColumn("pos_weight", F.round(F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")), 6))


def batches(df: DataFrame, key: str, seed: int, batch_size: int, out: str = "batch_id") -> DataFrame:
    """Shuffled batches, ``floor((rank - 1) / batch_size)`` in hash order."""
    r = hash_rank(df, key, seed, out="_rk", size_col=None)
    return r.withColumn(out, F.floor((F.col("_rk") - 1) / batch_size).cast("long")).drop("_rk")


def balanced_draws(df: DataFrame, key: str, label: str, seed: int = 42, batch_size: int = 32,
                   by: Sequence[str] = ()) -> DataFrame:
    """As many draws as rows, with replacement, classes equally likely, within ``by`` (e.g. fold).

    Returns ``by``, ``draw_id`` (0-based), ``batch_id`` and the drawn row's
    columns.  Rows are ranked once per (by, class); draw ``i`` is whatever row
    has place ``i`` in its group, so the draws need no table of their own, and
    class sizes ride on the bucket offsets.  Each draw then fetches the row of
    its class and rank by an equi-join.
    """
    by = list(by)
    x, counts = bucket_counts(df, key, f"{seed}|row", [*by, label])
    sizes = group_sizes(counts, [*by, label], "_nc")
    order = Window.partitionBy(*by).orderBy(label)  # one row per class
    # per group: where each class starts, and the list of (class, size)
    cls = sizes.withColumn("_start", F.coalesce(F.sum("_nc").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table = F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), F.col("_nc").alias("n"))).over(Window.partitionBy(*by)))
    cls = cls.select(*by, label, "_start", table.alias("_classes"))
    offs = join_small(bucket_offsets(counts, [*by, label]), cls, [*by, label])
    ranked = rank_rows(x, offs, key, [*by, label], "_rk")
    draw = (F.col("_start") + F.col("_rk") - 1).cast("long")
    d = ranked.select(*by, "_classes", draw.alias("draw_id"))
    text = F.concat(F.lit("|"), F.col("draw_id").cast("string"))
    hc, hr = (hash_uint60(F.md5(F.concat(F.lit(f"{seed}|{c}"), text))) for c in "cr")
    pick = F.get("_classes", scaled(hc, F.size("_classes")).cast("int"))
    d = d.withColumn("_pick", pick)
    d = d.select(*by, "draw_id", F.col("_pick.label").alias(label), (scaled(hr, F.col("_pick.n")) + 1).alias("_rk"))
    out = join_rows(ranked.drop("_start", "_classes"), d, [*by, label, "_rk"])
    return out.withColumn("batch_id", F.floor(F.col("draw_id") / batch_size).cast("long")).drop("_rk")


def batch_balance(draws: DataFrame, label: str, batch: str = "batch_id", by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per batch (every batch)."""
    return draws.groupBy(*by, batch).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"))
