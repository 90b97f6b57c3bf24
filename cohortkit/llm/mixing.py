"""Operator 8, mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Every document has a 64-bit hash; its top bits name one of ``BLOCKS`` blocks of
its source, so the blocks of a source are permuted by the hash and hold about
the same share of it.  Each source's target is turned into whole passes over
its blocks plus a prefix of the permuted blocks; block, sub-block and row sums
place the end of that prefix to a document.  The tree splits the sources' exact
block quotas among the output shards (one number per source and shard, in a
task; beyond ``MAX_SOURCES`` sources groups of them have a tree each), the shards draw disjoint runs of the permuted blocks, and a hash gives
each document its place within the shard.

Edge cases: null texts have size 0; a null source is a source of its own, last
in the order; sources without words get target 0; documents of size 0 follow
their block; repeated rows are separate documents and share their hash, so
they are drawn by row; an empty table gives an empty result; columns beside
id, source and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import WORD, read, stage
from cohortkit.llm.registry import query

#: Blocks per source, and sub-blocks of the block in which a draw ends.
BLOCK_BITS = 12
BLOCKS = 1 << BLOCK_BITS
#: Rows of tables of sources that may be broadcast (beyond, they are joined by shuffles), and sources of one tree, about.
MAX_SOURCES = 100_000
#: Rows (source, block) of the table of draws that may be broadcast; beyond it is joined by a shuffle.
MAX_BROADCAST_BLOCKS = 1 << 18


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds weight and target to (source, source_size).

    A source is capped when the water level times its weight exceeds its cap;
    in ascending order of cap / weight the capped sources come first, so the
    level is the first one that its own source need not be capped for.
    """
    named = sources.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("_i") % len(weights) + 1).cast("int"))
    room = named.withColumn("weight", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_i")
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(after))
    leveled = room.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("weight") <= F.col("_cap"))
    water = F.min_by(F.col("_level"), F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("weight"), F.col("_i")))).over(whole)
    goal = F.when(water.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), water * F.col("weight")))
    return leveled.select("source", "source_size", "weight", goal.alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(sources, shards) block counts: each tree node draws its left half's blocks without replacement.

    A half that is no whole number is rounded at random, so that many small trees fill all shards alike.
    """
    out = np.zeros((len(quotas), shards), np.int64)
    todo = [(0, shards, np.asarray(quotas, np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1:
            out[:, a] = q
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        take = (int(q.sum()) * (mid - a) + int(rng.integers(b - a))) // (b - a)
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if take else np.zeros_like(q)
        todo += [(a, mid, left), (mid, b, q - left)]
    return out


def shard_ends(counted: DataFrame, shards: int, seed: int, each: int) -> DataFrame:
    """(source, ends) of (source, passes, n, part): running sums of the tree's block counts over the shards.

    Groups of about ``each`` sources have a tree of their own, which a task draws.
    """
    schema = T.StructType([T.StructField("source", counted.schema["source"].dataType), T.StructField("ends", T.ArrayType(T.LongType()))])
    quota = counted.select("source", (F.col("passes") * F.col("n") + F.col("part")).cast("long").alias("quota"))
    groups = -(-counted.count() // each)

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("source")
        ends = np.cumsum(split_quotas(table["quota"].to_numpy(), shards, seed + key[0].as_py()), axis=1)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, ends.size + 1, shards), pa.int32()), pa.array(ends.ravel()))
        return pa.table({"source": table["source"], "ends": cells})

    dealt = quota.withColumn("_g", F.pmod(F.xxhash64("source"), F.lit(max(groups, 1))))
    return dealt.groupBy("_g").applyInArrow(draw, schema)


def _ends(rows: DataFrame, key: Column, rest: Column) -> DataFrame:
    """Per source the first ``key`` at which the running sum of sizes passes ``rest``: (source, _key, _rest)."""
    sums = rows.groupBy("source", "_rest", key.alias("_key")).agg(F.sum("size").alias("_s"))
    run = F.sum("_s").over(Window.partitionBy("source").orderBy("_key"))
    return (sums.withColumn("_run", run).filter(F.col("_run") > F.col("_rest"))
            .groupBy("source").agg(F.min(F.struct("_key", (F.col("_rest") - F.col("_run") + F.col("_s")).alias("_rest"))).alias("m"))
            .select("source", "m._key", "m._rest"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("size", words).withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0,
        shards: int = 64, seed: int = 17, whole_rows: bool = False) -> DataFrame:
    """Per document its size, its source's size and target, and the output shards that take a copy of it.

    Columns: doc_id, source, size, source_size, target, draws (array of
    (copy, shard, position)); with ``whole_rows`` the columns of ``docs`` and
    ``_draws``.  Exploding ``draws``, writing by shard and sorting by position
    within it gives the mix.
    """
    rows = stage(_sized(docs, seed).select("doc_id", "source", "size", "_h"), "op8-sizes")
    block = F.shiftrightunsigned("_h", 64 - BLOCK_BITS)
    sub = F.shiftrightunsigned("_h", 64 - 2 * BLOCK_BITS).bitwiseAND(F.lit(BLOCKS - 1))
    # An unsigned order of the hash, as a signed number.
    at = F.col("_h").bitwiseXOR(F.lit(-(1 << 63)))

    blocks = stage(rows.groupBy("source", block.alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("n")), "op8-blocks")
    per_source = targets(blocks.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    src = stage(per_source.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
                .withColumn("_rest", F.col("target") - F.col("passes") * F.col("source_size")), "op8-sources")
    n_sources = src.count()
    few = n_sources <= MAX_SOURCES
    send = F.broadcast if few else lambda table: table
    src = send(src)

    def joined(left: DataFrame, right: DataFrame, *more: Column) -> DataFrame:
        """Null-safe join on source (and further conditions) with a table that has one row per source."""
        right = right.withColumnRenamed("source", "_source")
        cond = left["source"].eqNullSafe(right["_source"])
        for m in more:
            cond = cond & m
        return left.join(send(right), cond).drop("_source")

    # Where the last, partial pass ends: block, then sub-block, then document.
    e1 = stage(_ends(joined(blocks, src.select("source", "_rest")), F.col("block"), F.col("_rest")), "op8-ends")
    in1 = joined(rows, e1.select("source", F.col("_key").alias("_b1"), "_rest"), block == F.col("_b1"))
    e2 = _ends(in1, sub, F.col("_rest")).select("source", F.col("_key").alias("_b2"), "_rest")
    in2 = joined(in1.drop("_rest"), e2, sub == F.col("_b2"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy(at, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # A document belongs to the draw when at least half of it lies before the end.
    last = (in2.withColumn("_run", run).filter(F.col("_run") - F.col("size") / 2 > F.col("_rest"))
            .groupBy("source").agg(F.min(F.struct(at.alias("at"), F.col("doc_id"))).alias("_end")))
    plan = stage(src.join(e1.select(F.col("source").alias("_s1"), F.col("_key").alias("_b1")), F.col("source").eqNullSafe(F.col("_s1")), "left")
                 .join(e2.select(F.col("source").alias("_s2"), "_b2"), F.col("source").eqNullSafe(F.col("_s2")), "left")
                 .join(last.select(F.col("source").alias("_s3"), "_end"), F.col("source").eqNullSafe(F.col("_s3")), "left")
                 .drop("_s1", "_s2", "_s3"), "op8-plan")

    # Block quotas: every pass draws each block that has documents, the partial one those before its end.
    counted = (joined(blocks, plan.select("source", "passes", "_b1", "_rest"))
               .groupBy("source").agg(F.first("passes").alias("passes"), F.count("*").alias("n"),
                                      F.count(F.when((F.col("_rest") > 0) & (F.coalesce(F.col("block") <= F.col("_b1"), F.lit(True))), 1)).alias("part")))
    ends = stage(shard_ends(counted, shards, seed, MAX_SOURCES), "op8-ends")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("block")) - 1
    ranked = blocks.withColumn("_rank", rank).withColumn("_n", F.count("*").over(Window.partitionBy("source")))

    def shard_of(draw: Column) -> Column:
        return F.size(F.filter(F.col("ends"), lambda e: e <= draw)).cast("int")

    dealt = joined(joined(ranked, ends), plan.select("source", "passes")).select(
        F.col("source").alias("_bs"), F.col("block").alias("_bb"),
        F.transform(F.sequence(F.lit(0), F.col("passes").cast("int")),
                    lambda c: shard_of(F.col("_rank") + c.cast("long") * F.col("_n"))).alias("_shards"))

    if n_sources * BLOCKS <= MAX_BROADCAST_BLOCKS:
        dealt = F.broadcast(dealt)
    # Lexicographic order of (block, sub-block, hash, id) against the end of the partial pass.
    here = F.struct(at.alias("at"), F.col("doc_id"))
    before_end = (F.when(F.col("_rest") <= 0, False).when(F.col("_b1").isNull() | (block < F.col("_b1")), True).when(block > F.col("_b1"), False)
                  .when(F.col("_b2").isNull() | (sub < F.col("_b2")), True).when(sub > F.col("_b2"), False)
                  .when(F.col("_end").isNull(), True).otherwise(here < F.col("_end")))
    # What is still missing or too much is made up by the one document whose size comes nearest to it.
    drawn = joined(rows, plan.drop("weight", "passes", "target", "source_size")).withColumn("_drawn", before_end)
    gap = stage(drawn.groupBy("source").agg((F.first("_rest") - F.sum(F.when(F.col("_drawn"), F.col("size")).otherwise(0))).alias("_gap")), "op8-gaps")
    off = F.abs(F.col("size") - F.abs("_gap"))
    apt = (F.col("_rest") > 0) & (F.col("_drawn") == (F.col("_gap") < 0)) & (off < F.abs("_gap"))
    swap = (joined(drawn, gap).filter(apt).groupBy(F.col("source").alias("_s4"))
            .agg(F.min(F.struct(off.alias("off"), here.alias("here"))).alias("_swap")))
    plan = stage(plan.join(swap, F.col("source").eqNullSafe(F.col("_s4")), "left").drop("_s4"), "op8-plan")
    taken = _sized(docs.select([F.col(c).alias(f"_doc_{c}") for c in docs.columns] + ["doc_id", "source", "text"]), seed).drop("text") if whole_rows else rows
    whole = joined(taken, plan.drop("weight"))
    n = F.col("passes").cast("int") + (before_end != F.coalesce(here.eqNullSafe(F.col("_swap.here")), F.lit(False))).cast("int")
    with_shards = whole.withColumn("_copies", n).withColumn("_block", block).join(
        dealt, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_bb")), "left")
    # A document that was taken to fill a gap lies beyond the quotas: any shard will do.
    draws = F.transform(F.slice("_shards", F.lit(1), F.col("_copies")), lambda s, i: F.struct(
        i.alias("copy"), F.when(s < shards, s).otherwise(F.pmod(F.col("_h"), F.lit(shards)).cast("int")).alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("_h"), i).alias("position")))
    if whole_rows:
        return with_shards.select(*(F.col(f"_doc_{c}").alias(c) for c in docs.columns), draws.alias("_draws"))
    return with_shards.select("doc_id", "source", "size", "source_size", "target", draws.alias("draws"))


def mixed_rows(docs: DataFrame, **args) -> DataFrame:
    """A row of ``docs`` for each copy that the mix takes, with copy, shard and position (unless ``docs`` has them)."""
    drawn = mix(docs, whole_rows=True, **args)
    copies = drawn.select(*docs.columns, F.explode("_draws").alias("_draw"))
    return copies.select(*docs.columns, *(F.col(f"_draw.{c}") for c in ("copy", "shard", "position") if c not in docs.columns))


@query("op8_mix_sources")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("size") * F.size("draws")).cast("long").alias("taken"), "source", "draws")
