"""Model evaluation as DataFrame aggregations.

Everything is grouped by caller-chosen keys (fold, follow-up threshold,
epoch, ...), so all folds and thresholds are scored in one job.  Rows are
pre-aggregated by distinct score before anything is replicated or ordered:
the data that moves after the first shuffle is one row per (group, score),
not one per prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.recode import nan_to_null
from cohortkit.operators.ranking import running_total

# Default decision cut-offs of the two training stacks.
CUTOFF_STRICT = 0.5       # PyTorch path: prob > 0.5
CUTOFF_KERAS = 0.731      # Keras path: prob >= 0.731 after softmax
AUC_BUCKETS = 1024        # order-preserving score buckets per power of two for the AUC scan
CLAMP_YEARS = (0.0, 10.0)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P24-P27 score functions ------------------------------------------------

def sigmoid(x: str | Column) -> Column:
    """Logistic of a raw score."""
    return 1.0 / (1.0 + F.exp(-_c(x)))


def logit(p: str | Column) -> Column:
    return F.log(_c(p) / (1.0 - _c(p)))


def softplus(z: str | Column) -> Column:
    """log(1 + e^z), stable for large |z|."""
    z = _c(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def softmax2(p: str | Column, applications: int = 1) -> Column:
    """P25: class-1 softmax of two outputs whose class-1 value is ``p`` and
    class-0 value is ``1 - p``; applied ``applications`` times (the Keras
    path applies it twice, which squeezes probabilities into [0.269, 0.731])."""
    x = _c(p)
    for _ in range(applications):
        x = 1.0 / (1.0 + F.exp(1.0 - 2.0 * x))
    return x


def classify(score: str | Column, threshold: float = CUTOFF_STRICT, inclusive: bool = False) -> Column:
    """1 when score > threshold (or >= with ``inclusive``)."""
    s = _c(score)
    # Spark orders NaN above every number; a comparison with NaN is false here.  NULL stays NULL.
    over = s >= threshold if inclusive else s > threshold
    return F.when(F.isnan(s.cast("double")) & s.isNotNull(), 0).otherwise(over.cast("int"))


def clamp(x: str | Column, lo: float = CLAMP_YEARS[0], hi: float = CLAMP_YEARS[1]) -> Column:
    """Clamp predictions to [lo, hi]; a missing or NaN prediction stays missing."""
    v = nan_to_null(x)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


# --- M1-M3 ----------------------------------------------------------------

def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """M1: tn, fp, fn, tp per group (rows = truth, columns = prediction)."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
        F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
        F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"))


def rates(cm: DataFrame, digits: int = 6) -> DataFrame:
    """M2: accuracy, precision, recall, F1 from tn/fp/fn/tp; 0 when undefined."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    z = F.lit(0.0)
    prec = F.coalesce(F.try_divide(tp, tp + fp), z)
    rec = F.coalesce(F.try_divide(tp, tp + fn), z)
    f1 = F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), z)
    acc = F.coalesce(F.try_divide(tp + tn, tp + tn + fp + fn), z)
    return cm.select("*", F.round(acc, digits).alias("accuracy"), F.round(prec, digits).alias("precision"),
                     F.round(rec, digits).alias("recall"), F.round(f1, digits).alias("f1"))


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Pre-aggregation: positives and negatives per (group, distinct score)."""
    y = F.col(label)
    return df.groupBy(*by, score).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg"))


def _negatives_below(sc: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """Adds ``_nb`` = negatives with a strictly lower score in the group.

    Two-level scan (score buckets, then within a bucket), so a group with
    many distinct scores is spread over many tasks."""
    s = F.col(score).cast("double")
    # logarithmic buckets: any real score, small probabilities and logits alike, is spread out in order
    size = F.floor((F.log2(F.abs(s)) + 1100) * AUC_BUCKETS).cast("long") + 1
    b = F.when(s == 0, F.lit(0).cast("long")).when(s > 0, size).when(s < 0, -size)
    return running_total(sc, "neg", [score], b, by=by, out="_nb", inclusive=False)


def _auc_expr(digits: int = 6) -> Column:
    contrib = F.col("pos") * (F.col("_nb") + F.col("neg") / 2.0)
    return F.round(F.try_divide(F.sum(contrib), F.sum("pos").cast("double") * F.sum("neg").cast("double")), digits)


def auc_from_counts(sc: DataFrame, score: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """M3 on pre-aggregated counts: P(score_pos > score_neg) + ties / 2;
    NULL when a class is absent."""
    return _negatives_below(sc, score, by).groupBy(*by).agg(_auc_expr(digits).alias("auc"))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """M3: exact ROC AUC per group (equals ranking with average ties)."""
    return auc_from_counts(score_counts(df, label, score, by), score, by)


# --- M9 / M10 -------------------------------------------------------------

def metrics_by_followup(df: DataFrame, label: str, score: str, days: str,
                        years: Sequence[int] = (0, 5, 10), by: Sequence[str] = ("fold",),
                        threshold: float = CUTOFF_STRICT, inclusive: bool = False,
                        days_per_year: float = 365) -> DataFrame:
    """M9: confusion, rates and AUC per group and follow-up threshold.

    Thresholds are nested (>= 0y contains >= 5y contains >= 10y), so every row
    gets a level = how many thresholds it passes; rows are aggregated by
    (group, score, level) first and only that small table is replicated to
    the thresholds it belongs to.
    """
    years = sorted(years)
    by = list(by)
    # a threshold of 0 years is no filter: rows without a follow-up time count there too
    lvl = sum(F.lit(1) if y <= 0 else F.when(F.col(days) >= y * days_per_year, 1).otherwise(0) for y in years)
    pre = df.withColumn("_lvl", lvl).groupBy(*by, score, "_lvl").agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))
    ys = F.array(*[F.lit(y) for y in years])
    x = (pre.where(F.col("_lvl") > 0)
            .select(*by, score, "pos", "neg", F.explode(F.slice(ys, 1, F.col("_lvl"))).alias("years")))
    sc = x.groupBy(*by, "years", score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # one aggregation gives the confusion counts and the AUC of each group
    pred = classify(score, threshold, inclusive) == 1
    keys = [*by, "years"]
    g = _negatives_below(sc, score, keys).groupBy(*keys).agg(
        F.sum(F.when(~pred, F.col("neg")).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when(pred, F.col("neg")).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(~pred, F.col("pos")).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when(pred, F.col("pos")).otherwise(0)).cast("long").alias("tp"),
        _auc_expr().alias("auc"))
    g = g.withColumn("n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    return rates(g).select(*keys, "tn", "fp", "fn", "tp", "n", "accuracy", "precision", "recall", "f1", "auc")


def round_exact(x: Column, digits: int = 6) -> Column:
    """Round a mean of already-rounded values: such means often sit exactly
    on a tie one digit further, where float-sum noise would decide the
    direction.  DECIMAL(38,10) removes the noise, then half-up rounding."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def _fixed(x: Column, decimals: int) -> Column:
    """Fixed-point text, rounded half-up on the decimal value.  Going through
    DECIMAL(38,10) first removes last-bit noise of float sums, so the text
    does not depend on the order the partial sums were merged."""
    return x.cast("decimal(38,10)").cast(f"decimal(38,{decimals})").cast("string")


def fold_summary(per_fold: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("years",),
                 decimals: int = 4) -> DataFrame:
    """Mean and population std over folds, as numbers and as the
    reference's text ``'0.1234 ± 0.0056'``."""
    aggs = []
    for m in metrics:
        mu, sd = F.avg(m), F.stddev_pop(m)
        aggs += [round_exact(mu).alias(f"{m}_mean"), round_exact(sd).alias(f"{m}_std"),
                 F.concat_ws(" ± ", _fixed(mu, decimals), _fixed(sd, decimals)).alias(f"{m}_text")]
    return per_fold.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


# --- M4-M8 losses ---------------------------------------------------------

def _batch_pairs_loss(items: Column, variant: str) -> Column:
    """Mean pair loss over positives x negatives of one bounded batch array."""
    pos = F.filter(items, lambda e: e["y"] == 1)
    neg = F.filter(items, lambda e: e["y"] == 0)
    if variant == "softplus":
        def pair(p, n):
            d = n["s"] - p["s"]
            return F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))
    else:
        def pair(p, n):
            return 1.0 / (1.0 + F.exp(-(p["s"] - n["s"])))
    per_pos = F.transform(pos, lambda p: F.aggregate(neg, F.lit(0.0), lambda acc, n: acc + pair(p, n)))
    total = F.aggregate(per_pos, F.lit(0.0), lambda acc, v: acc + v)
    n_pairs = (F.size(pos) * F.size(neg)).cast("double")
    mean = F.try_divide(total, n_pairs)
    if variant == "softplus":
        loss = F.greatest(mean, F.lit(0.0))
    else:
        loss = F.least(F.greatest(1.0 - mean, F.lit(0.0)), F.lit(1.0))
    bad = loss.isNull() | F.isnan(loss) | (F.abs(loss) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(loss)


def pair_loss_per_batch(df: DataFrame, label: str, score: str, batch: str = "batch_id",
                        variant: str = "softplus", by: Sequence[str] = ()) -> DataFrame:
    """M4 (``softplus``: mean softplus(neg - pos)) and M5 (``sigmoid``:
    1 - mean sigmoid(pos - neg), clamped to [0, 1]) per batch; 0 when the batch
    lacks a class or the value is not finite.

    A batch holds at most ``batch_size`` rows by construction (X6), so its
    scores are gathered into one bounded array and the pairs are summed
    inside the expression; no pair rows are materialised.
    """
    items = F.collect_list(F.struct(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s")))
    g = df.groupBy(*by, batch).agg(items.alias("_it"), F.count(F.lit(1)).alias("n"))
    return g.select(*by, batch, "n",
                    F.size(F.filter("_it", lambda e: e["y"] == 1)).alias("n_pos"),
                    F.size(F.filter("_it", lambda e: e["y"] == 0)).alias("n_neg"),
                    F.round(_batch_pairs_loss(F.col("_it"), variant), 6).alias("loss"))


def weighted_bce(df: DataFrame, label: str, logit_col: str, pos_weight: float | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """M6: mean binary cross-entropy on raw scores with a positive-class
    weight: ``pw * y * softplus(-x) + (1 - y) * softplus(x)``.

    Without ``pos_weight`` it is the group's own ratio of negatives to
    positives (A5), taken from the same aggregate.
    """
    y, x = F.col(label), F.col(logit_col)
    pos, neg = F.sum(F.when(y == 1, softplus(-x))), F.sum(F.when(y == 0, softplus(x)))
    g = df.groupBy(*by).agg(pos.alias("_p"), neg.alias("_n"), F.count(F.when(y == 1, 1)).alias("_np"),
                            F.count(F.when(y == 0, 1)).alias("_nn"), F.count(F.lit(1)).alias("n"))
    pw = F.try_divide(F.col("_nn").cast("double"), F.col("_np")) if pos_weight is None else F.lit(float(pos_weight))
    total = pw * F.coalesce("_p", F.lit(0.0)) + F.coalesce("_n", F.lit(0.0))
    return g.select(*by, F.round(total / (F.col("_np") + F.col("_nn")), 6).alias("bce"), "n")


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = (), out: str = "mean_loss") -> DataFrame:
    """M8: size-weighted mean (running loss / dataset size)."""
    return df.groupBy(*by).agg(
        round_exact(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight).cast("double"))).alias(out))


def regression_errors(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """M7: MAE, MSE, RMSE, R^2 per group.

    R^2 = 1 - SSE / (n * var_pop(y)); Spark's variance aggregate merges
    centred partial moments, so it stays accurate for large values.
    """
    e = F.col(pred) - F.col(y)
    n = F.count(F.lit(1))
    sse = F.sum(e * e)
    sst = n * F.var_pop(y)
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(sse / n, 6).alias("mse"),
        F.round(F.sqrt(sse / n), 6).alias("rmse"),
        F.round(1.0 - F.try_divide(sse, sst), 6).alias("r2"))
