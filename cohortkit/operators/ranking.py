"""Global order without a single task.

A window with ``orderBy`` but no ``partitionBy`` sends every row to one task.
The operators here get the same answer in two levels:

1. cut the order key into buckets that preserve order,
2. aggregate once per bucket (count, or last non-NULL value),
3. scan the small bucket table (the only scan over many buckets; its size is
   bounded by the bucket count, not by the data),
4. join the per-bucket carry back and finish with a window partitioned by
   bucket.

A hot group (say a third of all rows in one class) is split across buckets,
so no task sees more than one bucket of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of md5 used as order-preserving bucket: 16**3 = 4,096 buckets per group.
HASH_PREFIX = 3
# Bits of the row id within a bucket of the forward fill, and within a bucket of those buckets.
CARRY_BITS = (18, 40)


def _null_safe(df: DataFrame, other: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on ``on`` in which NULL equals NULL; ``on`` is kept once, from ``df``."""
    other = other.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in other.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return df.join(other, cond, how).drop(*[f"_on_{c}" for c in on])


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``small``, a table made from it that holds each of its keys once; NULL equals NULL.

    The join is an outer one, though every row has its match, because Spark
    then never broadcasts ``df``: it takes a stored table for as small as its
    compressed file, and an exploded one for no larger.
    """
    return _null_safe(df, small, on, "left")


def join_rows(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of two tables that both grow with the input: both are shuffled, whatever their files' sizes; NULL equals NULL."""
    return _null_safe(df.hint("merge"), other, on, "inner")


def hash_key(seed: int | str, key: str | Column) -> Column:
    """Deterministic order key: ``md5('<seed>|<key>')`` (same text in DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def hash_uint60(text: Column) -> Column:
    """First 15 hex digits of an md5 text as an integer in [0, 2**60)."""
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def scaled(h: Column, n: Column) -> Column:
    """``floor(h * n / 2**60)`` for a 60-bit hash and any count, exact in DECIMAL."""
    wide = h.cast("decimal(19,0)") * n.cast("decimal(18,0)")
    return F.call_function("div", wide, F.lit(1 << 60).cast("decimal(19,0)")).cast("long")


def bucket_counts(df: DataFrame, key: str, seed: int | str, by: Sequence[str],
                  prefix: int = HASH_PREFIX) -> tuple[DataFrame, DataFrame]:
    """Rows with their hash bucket (``''`` for a NULL key), and the rows per (group, bucket)."""
    h = hash_key(seed, key)
    x = df.withColumn("_h", h).withColumn("_hb", F.coalesce(F.substring("_h", 1, prefix), F.lit("")))
    return x, x.groupBy(*by, "_hb").agg(F.count(F.lit(1)).alias("_cnt"))


def bucket_offsets(counts: DataFrame, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the group in earlier buckets (``_off``)."""
    before = Window.partitionBy(*by).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "_hb", *keep, F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))


def group_sizes(counts: DataFrame, by: Sequence[str], out: str = "n_group") -> DataFrame:
    """Group sizes from the bucket counts, so callers that need them do not read the rows again."""
    return counts.groupBy(*by).agg(F.sum("_cnt").alias(out))


def rank_rows(x: DataFrame, offs: DataFrame, key: str, by: Sequence[str], out: str) -> DataFrame:
    """Rank within ``by``; whatever else ``offs`` holds per (group, bucket) comes along.

    ``offs`` has at most (#groups x 16**prefix) rows; AQE broadcasts it when
    its measured size is under the broadcast threshold, else shuffles.  Rows
    whose group or key is NULL are ranked too (NULL keys in no order).
    """
    x = join_small(x, offs, [*by, "_hb"])
    w = Window.partitionBy(*by, "_hb").orderBy("_h", key)
    return x.withColumn(out, (F.row_number().over(w) + F.col("_off")).cast("long")).drop("_h", "_hb", "_off")


def hash_rank(df: DataFrame, key: str, seed: int | str, by: Sequence[str] = (),
              out: str = "rank", size_col: str | None = "n_group",
              prefix: int = HASH_PREFIX) -> DataFrame:
    """1-based row number within ``by``, ordered by ``(md5(seed|key), key)``.

    Equal to ``row_number() OVER (PARTITION BY by ORDER BY md5, key)`` but the
    widest task holds one md5-prefix bucket of one group.  ``key`` should be
    unique within ``by`` (it is the entity id).  Adds ``out`` and, if
    ``size_col`` is set, the group size (from the bucket table, no extra pass).
    """
    by = list(by)
    x, counts = bucket_counts(df, key, seed, by, prefix)
    offs = bucket_offsets(counts, by)
    if size_col:  # a window over the bucket table, of at most 16**prefix rows a group
        offs = bucket_offsets(counts.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*by))), by, (size_col,))
    return rank_rows(x, offs, key, by, out)


def _carry_in(last: DataFrame, by: list[str], bits: Sequence[int]) -> DataFrame:
    """Per bucket the last value of the buckets before it, bucket by bucket of buckets.

    ``last``: (by, ``_b``, ``_bl``).  The window over all rows of a group runs
    only over the coarsest buckets, of which 63-bit ids have 2**23 at most.
    """
    def before(*part: str):
        return Window.partitionBy(*by, *part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    if not bits:
        return last.select(*by, "_b", F.last("_bl", ignorenulls=True).over(before()).alias("_cin"))
    x = last.withColumn("_p", F.shiftright("_b", bits[0]))
    x = x.withColumn("_within", F.last("_bl", ignorenulls=True).over(before("_p")))
    tops = x.groupBy(*by, F.col("_p").alias("_b")).agg(
        F.max_by("_bl", F.when(F.col("_bl").isNotNull(), F.col("_b"))).alias("_bl"))
    top = _carry_in(tops, by, bits[1:]).withColumnRenamed("_b", "_p").withColumnRenamed("_cin", "_pin")
    x = join_small(x, top, [*by, "_p"])
    return x.select(*by, "_b", F.coalesce("_within", "_pin").alias("_cin"))


def carry_forward(df: DataFrame, value: str, order: str, by: Sequence[str] = (),
                  out: str | None = None, bits: Sequence[int] = CARRY_BITS) -> DataFrame:
    """Forward fill (W1): NULL ``value`` takes the last non-NULL value before it
    in ``order`` (within ``by`` when given; the whole table otherwise).

    ``order`` is an integer key (the row id of the sheet).  Rows stay where
    they are; no single task sees more than one bucket of row ids, or the
    coarsest bucket table.  A row without an ``order`` has no place in the
    sheet: it stays, is not filled and fills no other row.  Rows with a NULL
    group form one group.
    """
    by = list(by)
    out = out or value
    placed = F.col(order).isNotNull()
    # rows without a place are dealt over some buckets of their own, below all ids
    loose = F.lit(-(1 << 62)) - F.pmod(F.hash(value, *by), F.lit(4096))
    x = df.withColumn("_b", F.coalesce(F.shiftright(F.col(order).cast("long"), bits[0]), loose))
    upto = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_ff", F.when(placed, F.last(value, ignorenulls=True).over(upto)).otherwise(F.col(value)))
    last_in_bucket = x.groupBy(*by, "_b").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull() & placed, F.col(order))).alias("_bl"))
    steps = [b - a for a, b in zip(bits, bits[1:])]
    x = join_small(x, _carry_in(last_in_bucket, by, steps), [*by, "_b"])
    return x.withColumn(out, F.when(placed, F.coalesce("_ff", "_cin")).otherwise(F.col("_ff"))).drop("_b", "_ff", "_cin")


def running_total(df: DataFrame, value: str, order: Sequence[str], bucket: Column,
                  by: Sequence[str] = (), out: str = "running", inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` in ``order`` within ``by``, two-level.

    ``bucket`` must be a non-decreasing function of the order (for example a
    coarsened score).  ``inclusive=False`` sums strictly earlier rows only.
    """
    by = list(by)
    x = df.withColumn("_b", bucket)
    tot = x.groupBy(*by, "_b").agg(F.sum(value).alias("_bs"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*by, "_b", F.coalesce(F.sum("_bs").over(before), F.lit(0)).alias("_cin"))
    x = join_small(x, carry, [*by, "_b"])
    end = 0 if inclusive else -1
    w = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return x.withColumn(out, F.col("_cin") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_b", "_cin")
