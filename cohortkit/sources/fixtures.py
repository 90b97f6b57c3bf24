"""Stand-in inputs derived by Spark from the driver tables.

The reference does not ship its patient data, so site tables, score tables and
epoch logs are derived deterministically from the TPC-H-like tables.  All of
them grow with the input: one visit per order, one score per event, one run
per block of orders.  Missing values, junk text, blank cells, ties and half
ages are there on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.sources.tables import load_table

# Fixed value: epochs per run in the epoch-log stand-in (run = block of order keys).
HISTORY_EPOCHS = 60


def fx_site_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site A visit sheet: one visit per order, patient = customer.

    The biopsy date is the customer's first order date.  It is computed as a
    grouped ``min`` (partial aggregation before the shuffle) and joined back
    on the same key as the customer join, so both joins share one
    partitioning of ``orders`` by customer.
    """
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rb = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("rb"))
    j = o.join(rb, "o_custkey").join(c, o.o_custkey == c.c_custkey)
    return j.selectExpr(
        "CASE WHEN o_orderkey % 211 <> 5 THEN o_custkey END AS VALIGA_CODE",
        "CASE WHEN o_orderkey % 223 <> 7 THEN o_orderkey END AS row_id",
        "c_nationkey % 2 + 1 AS Gender1M2F",
        "20 + o_custkey % 50 + CAST(o_custkey % 4 AS DOUBLE) / 4 AS age",
        "date_format(rb, 'dd/MM/yyyy') AS RBdate",
        "date_format(o_orderdate, 'dd/MM/yyyy') AS Lastvisit",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN NULL "
        "ELSE CAST(o_orderkey % 97 AS STRING) END AS uprot_gday",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey + 5) % 89 AS STRING) END AS uprot_gday_last",
        "CASE WHEN o_orderkey % 17 = 0 THEN '?' ELSE CAST(1 + o_orderkey % 8 AS STRING) END AS creat_mgdl",
        "CAST(1 + (o_orderkey + 3) % 9 AS STRING) AS creat_mgdl_last",
        "CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE CAST(100 + o_orderkey % 70 AS STRING) END "
        "AS SystolicbloodpressuremmHg",
        "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(60 + o_orderkey % 45 AS STRING) END "
        "AS DiastolicbloodpressuremmHg",
        "CAST(105 + o_orderkey % 70 AS STRING) AS SBPlast", "CAST(62 + o_orderkey % 45 AS STRING) AS DBPlast",
        "o_custkey % 2 AS M", "o_custkey % 3 % 2 AS E", "o_custkey % 5 % 2 AS S", "o_custkey % 3 AS T",
        "o_custkey % 7 % 3 AS C",
        "CASE o_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN '1' END AS AceiYN",
        "CASE o_orderkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' END AS Fishoil",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE 'N' END AS CsIm",
        "CASE WHEN o_orderkey % 6 = 0 THEN 'Y' WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'N' END AS AZA",
        "CASE WHEN o_orderkey % 8 = 0 THEN '1' ELSE '0' END AS CELLCEPT",
        "CASE WHEN o_custkey % 4 = 0 THEN '1' WHEN o_custkey % 37 = 1 THEN NULL ELSE '0' END AS ESKDcorretto",
    )


def fx_site_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site B visit sheet: one visit per event, patient = 100 + user."""
    e = load_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return e.selectExpr(
        "100 + user_id AS `VALIGA CODE`", "event_id AS row_id",
        "CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS SEX",
        "user_id % 2 AS M", "user_id % 3 % 2 AS E", "user_id % 5 % 2 AS S", "user_id % 3 AS T",
        "user_id % 7 % 3 AS C",
        "(user_id % 15) * 365 + dayofmonth(ts) - 1 AS dateAssess",
        "CASE WHEN event_id % 21 = 0 THEN 'n/a' ELSE CAST(100 + event_id % 70 AS STRING) END AS systolic",
        "CAST(60 + event_id % 45 AS STRING) AS Diastolic",
        "18 + user_id % 60 + CAST(user_id % 2 AS DOUBLE) / 2 AS age",
        "CAST(1 + event_id % 7 AS STRING) AS creat_mg_dl",
        "CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS outcome",
        "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 83 AS STRING) END AS Uprot",
        "CASE WHEN event_id % 10 = 0 THEN '-' ELSE CAST(event_id % 4 AS STRING) END AS `Nb of Bpmeds`",
        "CAST(event_id % 2 AS STRING) AS `RAS blockers`",
        "CASE event_id % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' WHEN 3 THEN '0' END AS `fish oil`",
        "CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN '1' WHEN 2 THEN 'maybe' ELSE 'N' END AS Immunotherapies",
    )


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored test rows: label, probability on a 0.01 grid (many ties and
    exact 0.5 values), follow-up days (some missing, some negative)."""
    e = load_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    y = F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)
    h = (F.col("event_id") * 7919) % 101
    fu = (F.when(F.col("event_id") % 43 == 0, None).when(F.col("event_id") % 47 == 0, -5)
          .otherwise((F.col("user_id") % 15) * 365 + F.dayofmonth("ts") - 1))
    return e.select(
        F.col("event_id").alias("id"),
        y.alias("y"),
        ((20 + 30 * y + h % 50).cast("double") / 100).alias("prob"),
        fu.alias("fu_days"),
    )


def fx_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation log: a run per block of ``HISTORY_EPOCHS`` order keys.

    Each run has at most ``HISTORY_EPOCHS`` epochs (bounded by construction,
    like ``max_epochs`` bounds a real training run); the number of runs grows
    with the input.  Loss first falls, then wobbles (non-monotone).
    """
    o = load_table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    run = F.floor(k / HISTORY_EPOCHS).cast("long")
    ep = (k % HISTORY_EPOCHS + 1).cast("long")
    r = run % 25
    loss = (40 - F.least(ep, 20 + r) + (ep * (7 + r)) % 5).cast("double") / 40
    f1 = (50 + F.least(ep, 15 + r) + (ep * (3 + r)) % 7).cast("double") / 100
    # some losses and scores are not a number, some are missing
    loss = F.when(k % 97 == 3, float("nan")).when(k % 101 == 4, None).otherwise(loss)
    f1 = F.when(k % 89 == 2, float("nan")).when(k % 103 == 6, None).otherwise(f1)
    # a few runs log a single epoch, so that early stopping never looks at them
    short = (run % 37 == 11) & (ep > 1)
    return (o.where(~short).select(run.alias("run_id"), ep.alias("epoch"), loss.alias("val_loss"), f1.alias("val_f1")))
