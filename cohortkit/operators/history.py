"""Training-history operators.

An epoch log has one row per (run, epoch).  A run's length is bounded by its
``max_epochs`` setting, not by the data, so per-run work (a window or one
bounded array per run) never grows with the input; the number of runs does,
and runs are spread over partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.recode import nan_to_null


def early_stop(log: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss",
               patience: int = 2, min_delta: float = 0.0, check_every: int = 1) -> DataFrame:
    """Replay early stopping per run.

    Only epochs with ``epoch % check_every == 0`` are checks.  A check
    improves when ``loss + min_delta < best``; otherwise a counter grows and
    the run stops at the check where it reaches ``patience``.  With
    ``min_delta > 0`` the best value is not a running minimum, so the checks
    are folded in epoch order (``aggregate`` over the run's sorted checks,
    bounded by ``max_epochs / check_every``).

    Returns per run: ``n_checks`` (checks until the stop, inclusive; 0 for a
    run without any), ``best_epoch``, ``best_loss`` (restored weights),
    ``stop_epoch`` (NULL if it never stopped) and ``last_epoch``.  A NULL or
    NaN loss is no improvement.
    """
    check = F.when(F.col(epoch) % check_every == 0, F.struct(F.col(epoch).cast("long").alias("e"),
                                                             F.col(loss).cast("double").alias("l")))
    g = log.groupBy(run).agg(F.array_sort(F.collect_list(check)).alias("_it"),
                             F.max(epoch).cast("long").alias("last_epoch"))
    init = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("best_e"),
                    F.lit(0).alias("cnt"), F.lit(None).cast("long").alias("stop"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        done = acc["stop"].isNotNull()
        imp = F.coalesce((x["l"] + F.lit(min_delta)) < acc["best"], F.lit(False))
        cnt = F.when(imp, F.lit(0)).otherwise(acc["cnt"] + 1)
        return F.when(done, acc).otherwise(F.struct(
            F.when(imp, x["l"]).otherwise(acc["best"]).alias("best"),
            F.when(imp, x["e"]).otherwise(acc["best_e"]).alias("best_e"),
            cnt.alias("cnt"),
            F.when(~imp & (cnt >= patience), x["e"]).alias("stop"),
            (acc["n"] + 1).alias("n")))

    r = g.select(run, "last_epoch", F.aggregate("_it", init, step).alias("_s"))
    best = F.when(F.col("_s.best_e").isNotNull(), F.round(F.col("_s.best"), 6))
    return r.select(run, F.col("_s.n").cast("long").alias("n_checks"), F.col("_s.best_e").alias("best_epoch"),
                    best.alias("best_loss"), F.col("_s.stop").alias("stop_epoch"), "last_epoch")


def best_epoch(log: DataFrame, run: str = "run_id", epoch: str = "epoch", metric: str = "val_f1",
               mode: str = "max", carry: Sequence[str] = ()) -> DataFrame:
    """The epoch with the best metric; strict improvement, so the
    earliest epoch wins ties.  A NULL or NaN metric never wins.  One grouped
    ``max_by`` (partial aggregation)."""
    value = nan_to_null(metric)
    key = F.struct(value if mode == "max" else -value, -F.col(epoch))
    payload = F.struct(F.col(epoch).alias("best_epoch"), F.col(metric).alias(f"best_{metric}"),
                       *[F.col(c) for c in carry])
    return (log.groupBy(run).agg(F.max_by(payload, F.when(value.isNotNull(), key)).alias("_b"))
               .select(run, "_b.*"))


def balanced_score(f1: str = "f1", precision: str = "precision", recall: str = "recall",
                   penalty: float = 0.1) -> Column:
    """W9 score: F1 minus ``penalty`` x |precision - recall|."""
    return F.col(f1) - penalty * F.abs(F.col(precision) - F.col(recall))


def best_fold(per_fold: DataFrame, score: Column, fold: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """Fold with the highest score; the earliest fold wins ties.  A NULL
    or NaN score never wins."""
    cols = [c for c in per_fold.columns if c not in by]
    value = nan_to_null(score)
    key = F.when(value.isNotNull(), F.struct(value, -F.col(fold)))
    return (per_fold.groupBy(*by).agg(F.max_by(F.struct(*cols, score.alias("score")), key).alias("_b"))
                    .select(*by, "_b.*"))


def previous_best(current: DataFrame, stored: DataFrame, key: str, metric: str, default: float = 0.0) -> DataFrame:
    """Compare with the stored best; a missing or unreadable record
    counts as ``default``.  A NaN is no value on either side and improves
    nothing.  Left join on the key (one row per key each side)."""
    s = stored.select(key, nan_to_null(metric).alias("prev_best"))
    j = current.join(s, key, "left").withColumn("prev_best", F.coalesce("prev_best", F.lit(default)))
    return j.withColumn("improved", F.coalesce(nan_to_null(metric) > F.col("prev_best"), F.lit(False)).cast("int"))


def metric_log(history: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide epoch rows -> long (ids..., metric, value)."""
    return history.unpivot(list(ids), list(metrics), "metric", "value")
