"""X5 with arbitrary row weights, X6 with an order of its own in every epoch.

**Draws by weight.**  Rows lie on a line, each as long as its weight, in hash
order; a draw is a point of that line.  The index has two levels: weights summed
per hash bucket (4,096 rows), and running sums within a bucket.  Rows and points
meet in cells, the pieces into which the buckets' ends and ``slices`` cuts at
equal weight part the line: a cell has no more rows than a bucket and no more
points than a slice, so neither many light rows nor one heavy row make a large
task.  In a cell a point takes the last row that starts at or before it.

**Orders by epoch.**  Rows are ranked once.  Epoch e puts rank x at the place
that a Feistel permutation, keyed by seed and epoch, gives it; so every epoch
has another order without another sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.ranking import HASH_PREFIX, hash_key, hash_rank, hash_uint60, join_small

ROUNDS, MAX_WALK = 4, 40


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def weight_units(weight: Column, resolution: float = 1.0) -> Column:
    """A weight as a whole number of 1 / ``resolution``: 0 where it is null, NaN or not above 0.

    A weight beyond 10^19 units (infinity too) is an error of the query.
    """
    w = weight.cast("double")
    on = F.coalesce((w > 0) & ~F.isnan(w), F.lit(False))
    beyond = F.raise_error(F.lit("weight out of range: more than 10^19 units")).cast("decimal(19,0)")
    return F.when(on & (w * resolution >= 1e19), beyond).when(on, F.round(w * resolution).cast("decimal(19,0)")).otherwise(F.lit(0).cast("decimal(19,0)"))


def weighted_draws(df: DataFrame, key: str, weight: str, seed: int = 42, resolution: float = 1.0, slices: int = 1024) -> DataFrame:
    """(draw_id, ``key``): as many draws with replacement as rows, each row with probability weight / total.

    ``key`` should be unique.  Rows of weight 0 are never drawn; without any weight there are no draws.
    """
    x = df.select(F.col(key), weight_units(F.col(weight), resolution).alias("_u"), hash_key(f"{seed}|row", key).alias("_h"))
    x = x.withColumn("_hb", F.coalesce(F.substring("_h", 1, HASH_PREFIX), F.lit("")))
    every, before = Window.partitionBy(), Window.partitionBy().orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    index = (x.groupBy("_hb").agg(F.count(F.lit(1)).alias("_c"), F.sum("_u").alias("_b"))  # a row per hash bucket
             .select("_hb", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                     F.coalesce(F.sum("_b").over(before), F.lit(0)).cast("decimal(19,0)").alias("_from"), F.sum("_b").over(every).cast("decimal(19,0)").alias("_all")))
    order = Window.partitionBy("_hb").orderBy("_h", key)
    rows = join_small(x, F.broadcast(index.drop("_b")), ["_hb"]).where("_all > 0")
    rows = rows.withColumn("_rk", F.row_number().over(order) + F.col("_off"))
    rows = rows.withColumn("_to", (F.col("_from") + F.sum("_u").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("decimal(19,0)"))
    cut = lambda p: _div(p * F.lit(slices).cast("decimal(10,0)"), F.col("_all"))

    held = rows.where("_u > 0").withColumn("_lo", (F.col("_to") - F.col("_u")).cast("decimal(19,0)"))
    held = held.select("_hb", F.explode(F.sequence(cut(F.col("_lo")), cut(F.col("_to") - 1))).alias("_s"), F.col("_lo").alias("_p"), F.lit(0).alias("_k"),
                       F.struct(key).alias("_row"), F.lit(None).cast("long").alias("draw_id"))

    point = hash_uint60(F.md5(F.concat(F.lit(f"{seed}|w|"), (F.col("_rk") - 1).cast("string")))).cast("decimal(19,0)") * F.col("_all")
    points = rows.select("_all", (F.col("_rk") - 1).cast("long").alias("draw_id"), _div(point, F.lit(1 << 60).cast("decimal(19,0)")).cast("decimal(19,0)").alias("_p"))
    # The bucket of a point: binary search in the one row that lists the buckets' starts (at most 16^3 + 1).
    starts = index.where("_b > 0").agg(F.sort_array(F.collect_list(F.struct("_from", "_hb"))).alias("_i"))
    points = points.join(F.broadcast(starts))

    def step(at: Column, j: Column) -> Column:
        more = at + F.call_function("shiftleft", F.lit(1), j)
        return F.when((more < F.size("_i")) & (F.get("_i", more)["_from"] <= F.col("_p")), more).otherwise(at)

    at = F.aggregate(F.sequence(F.lit(4 * HASH_PREFIX), F.lit(0), F.lit(-1)), F.lit(0), step)
    points = points.select(F.get("_i", at)["_hb"].alias("_hb"), cut(F.col("_p")).alias("_s"), "_p", F.lit(1).alias("_k"),
                           F.lit(None).cast(held.schema["_row"].dataType).alias("_row"), "draw_id")
    cell = Window.partitionBy("_hb", "_s").orderBy("_p", "_k").rowsBetween(Window.unboundedPreceding, 0)
    met = held.unionByName(points).withColumn("_row", F.last("_row", ignorenulls=True).over(cell))
    return met.where("_k = 1").select("draw_id", f"_row.{key}")


def permuted(x: Column, n: Column, seed: int, epoch: Column) -> Column:
    """Place of rank ``x`` (0 to n - 1) in an epoch's order: a bijection of 0 to n - 1.

    A Feistel network over an a x b grid with a b - a < n <= a b; places beyond n are walked on, a time or two.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = _div(n + a - 1, a)

    def noise(r: Column, half: Column) -> Column:
        return hash_uint60(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), r.cast("string"), half.cast("string"))))

    def turn(s: Column, r: Column) -> Column:
        left = F.struct(((s["l"] + noise(r, s["r"])) % a).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), ((s["r"] + noise(r, s["l"])) % b).alias("r"))
        return F.when(r % 2 == 0, left).otherwise(right)

    def place(p: Column) -> Column:
        start = F.struct((p % a).alias("l"), _div(p, a).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] + a * s["r"])

    # Fewer than a places lie beyond n; where a is large, 40 of them in a row have no chance (a^-40), and would be an error.
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(a, F.lit(MAX_WALK))), place(x), lambda p, _: F.when(p < n, p).otherwise(place(p)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("no place found in the order")).cast("long"))


def epoch_batches(df: DataFrame, key: str, seed: int, epochs: int, batch_size: int) -> DataFrame:
    """Rows of ``df`` once per epoch (1 to ``epochs``) with ``position`` and ``batch_id`` in that epoch's order."""
    ranked = hash_rank(df, key, seed, out="_rk", size_col="_n")
    each = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(epochs).cast("long"))))
    each = each.withColumn("position", permuted(F.col("_rk") - 1, F.col("_n").cast("long"), seed, F.col("epoch"))).drop("_rk", "_n")
    return each.withColumn("batch_id", _div(F.col("position"), F.lit(batch_size)))
