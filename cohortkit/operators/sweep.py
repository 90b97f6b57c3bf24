"""All models of a sweep (folds x grid points) fitted together, one scan of the rows per Newton step.

The objective is the weighted logistic loss of ``pyspark.ml`` with its L2
penalty (on coefficients times the weighted spread of their feature, intercept
free), so the coefficients are those of separate fits.  A model of fold f is
fitted on the rows outside fold f.  In one narrow pass over Arrow batches each
partition adds up loss, gradient and the Gram matrix x x' p (1 - p) of every
model as matrix products; one aggregate sums them over the partitions, and
models x (d + 1) (d + 2) / 2 numbers come to the driver, which takes the steps.
Weighted spreads per training part are totals less the held-out fold's.

Rows with a null label, weight or feature are left out; a null fold is held out
of no model.  A constant feature gets weight 0, features that depend on each
other the least-norm solution.  A model whose classes can be separated has no
finite optimum without a penalty: its steps end at ``max_iter``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.operators import features as FT
from cohortkit.operators import metrics as MT
from cohortkit.session import cut_lineage


@dataclass(frozen=True)
class LinearModel:
    """Weights and intercept on unscaled features."""
    features: list[str]
    weights: np.ndarray
    intercept: float


@dataclass
class Sweep:
    """Models by (fold, grid point), their mean training losses without the penalty, Newton steps and scans."""
    models: dict[tuple[int, float], LinearModel]
    losses: dict[tuple[int, float], float]
    scans: int = 0
    columns: list[str] = field(default_factory=list)


#: Rows of a stored block (a block is one value of a Parquet table), and rows that a pass handles at a time.
BLOCK_ROWS, PIECE_ROWS = 64, 8192


def usable_rows(train: DataFrame, features: Sequence[str], label: str, weight: str | None, fold: str) -> DataFrame:
    """Columns in the order the pass reads them: features, label, weight, fold (0 where null); incomplete rows left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    out = train.select(*(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("y"),
                       w.alias("w"), F.coalesce(F.col(fold).cast("int"), F.lit(0)).alias("fold"))
    return out.na.drop().filter(~F.greatest(*(F.isnan(c) for c in out.columns[:-1])))


@dataclass(frozen=True)
class Frame:
    """Centre and spread in which the models' features are handled."""
    mean: np.ndarray
    std: np.ndarray

    def design(self, batch: pa.RecordBatch) -> np.ndarray:
        d = len(self.mean)
        x = np.column_stack([np.ones(batch.num_rows), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(d))])
        x[:, 1:] = (x[:, 1:] - self.mean) / self.std
        return x

    def raw(self, theta: np.ndarray) -> tuple[np.ndarray, float]:
        """(weights, intercept) on unscaled features."""
        w = theta[1:] / self.std
        return w, float(theta[0] - (w * self.mean).sum())


def common_frame(rows: DataFrame, d: int) -> Frame:
    """Means and population spreads of all usable rows: one aggregate."""
    r = FT.fit_scaler(rows, [f"x{i}" for i in range(d)]).first()
    get = lambda what: np.array([np.nan_to_num(r[f"{what}_x{i}"] if r[f"{what}_x{i}"] is not None else 0.0) for i in range(d)])
    std = get("std")
    return Frame(get("mean"), np.where(std > 0, std, 1.0))


def _pass(frame: Frame, theta: np.ndarray, held: np.ndarray, second: bool) -> Callable:
    """Arrow pass: per model [train loss, weight, held-out loss, weight, gradient, Gram matrix's upper triangle] of a partition."""
    p = theta.shape[1]
    iu, ju = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(theta), 4 + p + (len(iu) if second else 0)))
        for b in batches:
            for z, y, w, fold in _parts(frame, b):
                s = z @ theta.T
                prob = 0.5 * (1 + np.tanh(s / 2))
                loss = w * (np.maximum(s, 0) + np.log1p(np.exp(-np.abs(s))) - y * s)
                out = fold == held
                inside = np.where(out, 0.0, w)
                total[:, 0] += loss.sum(0) - (loss * out).sum(0)
                total[:, 1] += inside.sum(0)
                total[:, 2] += (loss * out).sum(0)
                total[:, 3] += w.sum() - inside.sum(0)
                total[:, 4:4 + p] += (inside * (prob - y)).T @ z
                if second:
                    total[:, 4 + p:] += (inside * prob * (1 - prob)).T @ (z[:, iu] * z[:, ju])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(theta)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["m", "s"])

    return run


def _parts(frame: Frame, b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(design matrix, label, weight, fold) of a batch of :func:`usable_rows`, or piece by piece of one of :func:`blocks`."""
    p = len(frame.mean) + 1
    if b.schema.names != ["block"]:
        yield frame.design(b), *(b.column(p - 1 + k).to_numpy(zero_copy_only=False)[:, None] for k in range(3))
        return
    column = b.column(0)
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    rows = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.float64).reshape(-1, p + 2)
    for a in range(0, len(rows), PIECE_ROWS):
        x = rows[a:a + PIECE_ROWS]
        z = np.column_stack([np.ones(len(x)), (x[:, :p - 1] - frame.mean) / frame.std])
        yield z, x[:, p - 1:p], x[:, p:p + 1], x[:, p + 1:]


def blocks(rows: DataFrame) -> DataFrame:
    """The rows of :func:`usable_rows` as ``block``s of doubles, ``BLOCK_ROWS`` rows in each, in even partitions.

    For tables that many passes read: a pass then neither decodes nor converts single values.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array([x[a:a + BLOCK_ROWS].tobytes() for a in range(0, len(x), BLOCK_ROWS)], pa.binary())], names=["block"])

    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "block binary")


def model_sums(rows: DataFrame, frame: Frame, theta: np.ndarray, held: np.ndarray, second: bool = True) -> DataFrame:
    """(m, pos, s): the sums of every model over all rows, or blocks of them; one scan and one aggregate."""
    each = rows.mapInArrow(_pass(frame, theta.copy(), held, second), "m int, s array<double>")
    return each.select("m", F.posexplode("s").alias("pos", "s")).groupBy("m", "pos").agg(F.sum("s").alias("s"))


@dataclass(frozen=True)
class Sums:
    loss: np.ndarray      # mean over the training rows
    held_loss: np.ndarray  # mean over the held-out rows; nan without any
    grad: np.ndarray
    gram: np.ndarray | None


def collect_sums(sums: DataFrame, m: int, p: int, second: bool = True) -> Sums:
    """The driver's copy: m rows of 4 + p (+ p (p + 1) / 2) numbers."""
    a = np.zeros((m, 4 + p + (p * (p + 1) // 2 if second else 0)))
    for r in sums.collect():
        a[r.m, r.pos] = r.s
    w = np.where(a[:, 1] > 0, a[:, 1], 1.0)
    gram = None
    if second:
        gram = np.zeros((m, p, p))
        iu, ju = np.triu_indices(p)
        gram[:, iu, ju] = gram[:, ju, iu] = a[:, 4 + p:] / w[:, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        held = np.where(a[:, 3] > 0, a[:, 2] / a[:, 3], np.nan)
    return Sums(a[:, 0] / w, held, a[:, 4:4 + p] / w[:, None], gram)


def _spreads(rows: DataFrame, frame: Frame, folds: Sequence[int]) -> np.ndarray:
    """Weighted sample spread of each feature in each fold's training part: totals less the held-out fold's."""
    d = len(frame.mean)
    z = [(F.col(f"x{i}") - float(frame.mean[i])) / float(frame.std[i]) for i in range(d)]
    aggs = [F.sum("w"), F.sum(F.col("w") * F.col("w")), *(F.sum(F.col("w") * c) for c in z), *(F.sum(F.col("w") * c * c) for c in z)]
    own = {r[0]: np.array(r[1:], float) for r in rows.groupBy("fold").agg(*(a.alias(f"a{i}") for i, a in enumerate(aggs))).collect()}
    every = sum(own.values(), np.zeros(2 + 2 * d))
    out = np.zeros((len(folds), d))
    for k, f in enumerate(folds):
        s = every - own.get(f, 0.0)
        w, free = s[0], (s[0] - s[1] / s[0]) if s[0] > 0 else 0.0
        if free > 0:
            var = np.maximum(s[2 + d:] - s[2:2 + d] ** 2 / w, 0.0) / free
            out[k] = np.where(var > 1e-18, np.sqrt(var), 0.0)
    return out


def fit_logistic_sweep(train: DataFrame, features: Sequence[str], grid: Sequence[float] = (0.0,), folds: Sequence[int] = range(1, 11),
                       label: str = "label", weight: str | None = "weight", fold: str = "fold", tol: float = 1e-9, max_iter: int = 30) -> Sweep:
    """One model per (fold, regParam of ``grid``) on the rows outside the fold.

    The columns that the fits need are stored once, so that a step reads nothing else.  Fold 0 fits on all rows.  Newton steps of all models go on together until no
    coefficient moves by ``tol``; a step that raises a model's objective is halved.
    """
    feats, folds = list(features), list(folds)
    rows = cut_lineage(usable_rows(train, feats, label, weight, fold), "sweep")
    frame = common_frame(rows, len(feats))
    spread = _spreads(rows, frame, folds)
    keys = [(f, float(g)) for f in folds for g in grid]
    held = np.array([f if f else -1 for f, _ in keys])
    penalty = np.array([g for _, g in keys])[:, None] * np.repeat(spread, len(grid), axis=0) ** 2
    free = np.column_stack([np.ones(len(keys), bool), np.repeat(spread, len(grid), axis=0) > 0])
    m, p = free.shape
    theta, move, size = np.zeros((m, p)), np.zeros((m, p)), np.ones(m)
    best, open_, scans = np.full(m, np.inf), np.ones(m, bool), 0
    losses = np.zeros(m)
    while open_.any() and scans < max_iter:
        sums = collect_sums(model_sums(rows, frame, theta, held), m, p)
        scans += 1
        goal = sums.loss + 0.5 * (penalty * theta[:, 1:] ** 2).sum(1)
        for k in np.flatnonzero(open_):
            if goal[k] > best[k] + 1e-13 * (1 + abs(best[k])) and size[k] > 1e-6:  # too far: half the step back
                size[k] /= 2
                theta[k] += size[k] * move[k]
                continue
            best[k], size[k], losses[k] = goal[k], 1.0, sums.loss[k]
            g = sums.grad[k].copy()
            h = sums.gram[k].copy()
            g[1:] += penalty[k] * theta[k, 1:]
            h[np.arange(1, p), np.arange(1, p)] += penalty[k]
            on = np.flatnonzero(free[k])
            move[k] = 0
            move[k, on] = np.linalg.lstsq(h[np.ix_(on, on)], g[on], rcond=1e-12)[0]
            theta[k] -= move[k]
            open_[k] = np.abs(move[k]).max() > tol
    models = {key: LinearModel(feats, *frame.raw(theta[k])) for k, key in enumerate(keys)}
    return Sweep(models, dict(zip(keys, losses.tolist())), scans, feats)


def score_models(df: DataFrame, models: dict[tuple[int, float], LinearModel], out: str, link: Callable[[Column], Column] = lambda x: x,
                 keep: Sequence[str] = (), own_fold: str | None = None) -> DataFrame:
    """Scores of all models as rows (``keep``, fold, reg, ``out``) from one scan; with ``own_fold`` of the row's own fold only."""
    def score(model: LinearModel) -> Column:
        return link(sum((F.col(f) * float(c) for f, c in zip(model.features, model.weights)), F.lit(model.intercept)))

    each = F.array(*[F.struct(F.lit(f).cast("long").alias("fold"), F.lit(g).alias("reg"), score(mod).alias(out)) for (f, g), mod in sorted(models.items())])
    if own_fold:
        each = F.filter(each, lambda e: e["fold"] == F.col(own_fold))
    return df.select(*keep, F.explode(each).alias("_s")).select(*keep, "_s.fold", "_s.reg", f"_s.{out}")


def grid_metrics(train: DataFrame, sweep: Sweep, label: str = "label", fold: str = "fold") -> DataFrame:
    """(fold, reg, auc): every model on the rows held out of it, all of them in one scan."""
    val = score_models(train, sweep.models, "prob", MT.sigmoid, (label,), own_fold=fold)
    return MT.auc(val, label, "prob", ["fold", "reg"])


def best_point(per_model: DataFrame, grid: Sequence[float]) -> float:
    """The grid point with the best mean AUC over the folds (undefined ones are left out); the earlier one of equals."""
    mean = {r.reg: r.a for r in per_model.groupBy("reg").agg(F.avg("auc").alias("a")).collect()}
    return max(map(float, grid), key=lambda g: mean.get(g) or 0.0)
