"""Deterministic train/test splits and folds.

Order comes from ``md5('<seed>|<key>')`` (see ``ranking.hash_rank``), so a
split depends only on the seed and the keys: not on partitioning, not on the
executor that computed it, and it is the same text in DuckDB.  Class quotas
follow the largest-remainder rule of stratified shuffling: training counts
per class first, the test set takes the rest; remainder ties go to the
smaller label.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.ranking import bucket_counts, bucket_offsets, group_sizes, hash_rank, join_small, rank_rows


def _fraction(frac: float) -> Fraction:
    return Fraction(frac).limit_denominator(10**6)


def _wide(c: Column) -> Column:
    """Counts as DECIMAL, so that products of two of them cannot overflow."""
    return c.cast("decimal(19,0)")


def _div(a: Column, b: Column) -> Column:
    """Exact integer quotient."""
    return F.call_function("div", a, b).cast("long")


def n_test_of(n: Column, test_frac: float) -> Column:
    """ceil(test_frac * n) in exact integer arithmetic."""
    q = _fraction(test_frac)
    num, den = (F.lit(x).cast("decimal(7,0)") for x in (q.numerator, q.denominator))
    return _div(_wide(n) * num + den - 1, den)


def class_quotas(sizes: DataFrame, label: str, test_frac: float) -> DataFrame:
    """One row per class: ``n_c``, ``train_c``, ``test_c``, ``train_off``.

    ``sizes`` is the class-size table (``label``, ``n_group``).
    ``train_off`` = training rows of smaller labels (for fold dealing).  The
    windows here run over the class table (one row per class), never over
    data rows.
    """
    cls = sizes.select(label, F.col("n_group").alias("n_c"))
    allw = Window.partitionBy()
    n = F.sum("n_c").over(allw)
    x = cls.withColumn("_n", n).withColumn("_ntr", F.col("_n") - n_test_of(F.col("_n"), test_frac))
    prod = _wide(F.col("_ntr")) * F.col("n_c").cast("decimal(18,0)")
    x = x.withColumn("_fl", _div(prod, _wide(F.col("_n")))).withColumn("_rem", prod % _wide(F.col("_n")))
    x = x.withColumn("_need", F.col("_ntr") - F.sum("_fl").over(allw))
    x = x.withColumn("_pos", F.row_number().over(Window.orderBy(F.desc("_rem"), F.col(label))))
    x = x.withColumn("train_c", F.col("_fl") + F.when(F.col("_pos") <= F.col("_need"), 1).otherwise(0))
    x = x.withColumn("test_c", F.col("n_c") - F.col("train_c"))
    prev = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("train_off", F.coalesce(F.sum("train_c").over(prev), F.lit(0)).cast("long"))
    return x.select(label, "n_c", "train_c", "test_c", "train_off")


def stratified_split(df: DataFrame, key: str, label: str, seed: int = 42, test_frac: float = 0.2,
                     k: int = 10) -> DataFrame:
    """X1 + X3: ``is_test`` (stratified 80/20) and ``fold`` 1..k over the
    training rows (stratified k-fold), 0 for test rows.

    Per class the first ``test_c`` rows in hash order are test rows; training
    rows are dealt to folds round-robin continuing across classes in label
    order, which gives the fold sizes of stratified k-fold.
    """
    x, counts = bucket_counts(df, key, seed, [label])
    quotas = class_quotas(group_sizes(counts, [label]), label, test_frac).drop("n_c", "train_c")
    # quotas ride on the bucket offsets: the rows are joined once, on (label, bucket)
    offs = join_small(bucket_offsets(counts, [label]), quotas, [label])
    x = rank_rows(x, offs, key, [label], "_rk")
    is_test = F.col("_rk") <= F.col("test_c")
    fold = ((F.col("_rk") - F.col("test_c") - 1 + F.col("train_off")) % k + 1).cast("long")
    return (x.withColumn("is_test", is_test.cast("int"))
             .withColumn("fold", F.when(is_test, F.lit(0).cast("long")).otherwise(fold))
             .drop("_rk", "test_c", "train_off"))


def stratified_folds(df: DataFrame, key: str, label: str, seed: int = 42, k: int = 10) -> DataFrame:
    """X3 alone: stratified k-fold over all rows (``fold`` 1..k)."""
    x, counts = bucket_counts(df, key, seed, [label])
    prev = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    cls = group_sizes(counts, [label]).select(label, F.coalesce(F.sum("n_group").over(prev), F.lit(0)).alias("_start"))
    offs = join_small(bucket_offsets(counts, [label]), cls, [label])
    x = rank_rows(x, offs, key, [label], "_rk")
    return x.withColumn("fold", ((F.col("_rk") - 1 + F.col("_start")) % k + 1).cast("long")).drop("_rk", "_start")


def plain_split(df: DataFrame, key: str, seed: int = 42, test_frac: float = 0.2, k: int = 10) -> DataFrame:
    """X2 + X4: first ceil(test_frac * n) rows in hash order are test rows;
    training rows get ``fold`` = position mod k (k-fold sizes), test rows 0."""
    r = hash_rank(df, key, seed, out="_rk", size_col="_n")
    n_test = n_test_of(F.col("_n"), test_frac)
    is_test = F.col("_rk") <= n_test
    fold = ((F.col("_rk") - n_test - 1) % k + 1).cast("long")
    return (r.withColumn("is_test", is_test.cast("int"))
             .withColumn("fold", F.when(is_test, F.lit(0).cast("long")).otherwise(fold))
             .drop("_rk", "_n"))


def train_rows(split: DataFrame, fold: int | None = None) -> DataFrame:
    """Training rows (of one fold's training part when ``fold`` is set)."""
    x = split.where(F.col("is_test") == 0)
    return x if fold is None else x.where(F.col("fold") != fold)


def validation_rows(split: DataFrame, fold: int) -> DataFrame:
    return split.where((F.col("is_test") == 0) & (F.col("fold") == fold))


def test_rows(split: DataFrame) -> DataFrame:
    """Test rows."""
    return split.where(F.col("is_test") == 1)


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present in both sides (must be 0 for a leak-free split).

    ``left_semi`` join: shuffles keys only.
    """
    return a.select(key).join(b.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n_overlap"))
