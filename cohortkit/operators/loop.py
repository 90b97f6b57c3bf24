"""W6, W7, S9, S10 inside a fit: a resumable training loop with early stopping, all folds in one scan per epoch.

The state of a run is a table: per fold its weights, its best weights so far
with their epoch and loss, the number of misses and the stop epoch.  It is
written at every check, after the log rows of the epochs since the last one.
Both go to a folder named by the check's epoch, so that a check that is run
again replaces its own rows: a killed run resumes at its last complete state
and ends with the same weights and the same log.

An epoch is one gradient step of every fold that still trains.  The scan that
gives the next step's gradients also scores each fold's held-out rows with the
weights of the epoch before, so that a check costs no scan of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import features as FT
from cohortkit.operators import sweep as SW
from cohortkit.operators import training as TR
from cohortkit.session import cut_lineage
from cohortkit.sources.tables import path_exists

STATE = "fold long, epoch long, weights array<double>, best_weights array<double>, best_loss double, best_epoch long, misses long, n_checks long, stop_epoch long"
LOG = "run_id string, fold long, epoch long, metric string, value double"


@dataclass(frozen=True)
class Scan:
    """What one scan tells of every fold's current weights; ``held_loss`` is nan for a fold without held-out rows."""
    loss: np.ndarray
    held_loss: np.ndarray
    grad: np.ndarray


@dataclass(frozen=True)
class Rule:
    """Every ``check_every`` epochs; better if loss + ``min_delta`` < best; stop after ``patience`` misses."""
    check_every: int = 5
    patience: int = 3
    min_delta: float = 0.0
    max_epochs: int = 60


def _done(spark: SparkSession, folder: str, rule: Rule) -> int | None:
    """The last check whose state is complete; None before the first."""
    last = None
    for e in range(rule.check_every, rule.max_epochs + 1, rule.check_every):
        if not path_exists(spark, f"{folder}/state/epoch={e}/_SUCCESS"):
            break
        last = e
    return last


def read_state(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    return spark.read.schema(STATE.replace("epoch long,", "", 1)).parquet(f"{folder}/state/epoch={epoch}").withColumn("epoch", F.lit(epoch).cast("long"))


def read_log(spark: SparkSession, folder: str, rule: Rule) -> DataFrame:
    """The run's metric log up to its last complete check."""
    paths = [f"{folder}/log/upto={e}" for e in range(rule.check_every, (_done(spark, folder, rule) or 0) + 1, rule.check_every)]
    return spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)


def train_loop(spark: SparkSession, folder: str, run_id: str, folds: Sequence[int], start: np.ndarray,
               scan: Callable[[np.ndarray], Scan], rule: Rule = Rule(), step: float = 0.5, stop_after: int | None = None) -> DataFrame:
    """Trains to the end, or resumes the run in ``folder``; returns its last state (a row per fold).

    ``start`` has a row of weights per fold.  ``stop_after`` ends the call after
    that many scans, as a kill would (for tests).  A fold stops by the rule or at
    the last check within ``max_epochs``; a loss that is not a number is a miss.
    """
    k = len(folds)
    theta, best = start.astype(float).copy(), start.astype(float).copy()
    best_loss, best_epoch = np.full(k, np.inf), np.full(k, -1)
    misses, checks, stopped = np.zeros(k, int), np.zeros(k, int), np.full(k, -1)
    epoch = _done(spark, folder, rule) or 0
    if epoch:
        at = {f: i for i, f in enumerate(folds)}
        for r in read_state(spark, folder, epoch).collect():
            i = at[r.fold]
            theta[i], best[i] = r.weights, r.best_weights
            best_loss[i], best_epoch[i] = (np.inf, -1) if r.best_epoch is None else (r.best_loss, r.best_epoch)
            misses[i], checks[i], stopped[i] = r.misses, r.n_checks, -1 if r.stop_epoch is None else r.stop_epoch
    last = rule.max_epochs // rule.check_every * rule.check_every
    rows, scans, resumed = [], 0, epoch
    while epoch <= last and (stopped < 0).any():
        if stop_after is not None and scans >= stop_after:
            break
        s = scan(theta)
        scans += 1
        if epoch > resumed:
            on = np.flatnonzero(stopped < 0)
            rows += [(run_id, int(folds[i]), epoch, name, float(v[i])) for i in on for name, v in (("loss", s.loss), ("val_loss", s.held_loss))]
            if epoch % rule.check_every == 0:
                for i in on:
                    checks[i] += 1
                    if s.held_loss[i] + rule.min_delta < best_loss[i]:
                        best_loss[i], best_epoch[i], best[i], misses[i] = s.held_loss[i], epoch, theta[i], 0
                    else:
                        misses[i] += 1
                        if misses[i] >= rule.patience:
                            stopped[i] = epoch
                spark.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/upto={epoch}")
                state = [(int(f), epoch, theta[i].tolist(), best[i].tolist(), None if best_epoch[i] < 0 else float(best_loss[i]),
                          None if best_epoch[i] < 0 else int(best_epoch[i]), int(misses[i]), int(checks[i]), None if stopped[i] < 0 else int(stopped[i]))
                         for i, f in enumerate(folds)]
                spark.createDataFrame(state, STATE).drop("epoch").coalesce(1).write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")
                rows = []
        theta = np.where((stopped < 0)[:, None], theta - step * s.grad, theta)
        epoch += 1
    done = _done(spark, folder, rule)
    return read_state(spark, folder, done) if done else spark.createDataFrame([], STATE)


# --- what an epoch minimises --------------------------------------------------

@dataclass(frozen=True)
class FoldFrames:
    """Each fold's training means and spreads; weights live in its scaled features (A7, J5), intercept first."""
    mean: np.ndarray
    std: np.ndarray

    def raw(self, theta: np.ndarray) -> np.ndarray:
        """(intercept, weights) per fold on unscaled features."""
        w = theta[:, 1:] / self.std
        return np.column_stack([theta[:, 0] - (w * self.mean).sum(1), w])

    def gradient(self, grad: np.ndarray) -> np.ndarray:
        """The gradient for unscaled features as one for scaled features."""
        return np.column_stack([grad[:, 0], (grad[:, 1:] - grad[:, :1] * self.mean) / self.std])


def fold_frames(train: DataFrame, features: Sequence[str], folds: Sequence[int], fold: str = "fold") -> FoldFrames:
    """Scalers of the folds 1 to k that ``train`` has."""
    got = {r[fold]: r for r in FT.fold_scalers(train, list(features), fold, max(folds)).collect()}
    mean, std = (np.array([[float(got[f][f"{what}_{c}"]) for c in features] for f in folds]) for what in ("mean", "std"))
    return FoldFrames(mean, std)


def logistic_scan(train: DataFrame, features: Sequence[str], folds: Sequence[int], frames: FoldFrames, label: str = "label",
                  weight: str | None = "weight", fold: str = "fold") -> Callable[[np.ndarray], Scan]:
    """Weighted logistic loss (T3): mean over the training part, and over the held-out rows."""
    rows = cut_lineage(SW.blocks(SW.usable_rows(train, features, label, weight, fold)), "epochs")
    d = len(list(features))
    plain, held = SW.Frame(np.zeros(d), np.ones(d)), np.array(list(folds))

    def scan(theta: np.ndarray) -> Scan:
        s = SW.collect_sums(SW.model_sums(rows, plain, frames.raw(theta), held, second=False), len(held), d + 1, second=False)
        return Scan(s.loss, s.held_loss, frames.gradient(s.grad))

    return scan


def pairwise_scan(train: DataFrame, held_out: DataFrame, features: Sequence[str], folds: Sequence[int], frames: FoldFrames,
                  batch: str = "batch_id", label: str = "label", fold: str = "fold") -> Callable[[np.ndarray], Scan]:
    """Pairwise proxy-AUC loss (T4, M4): size-weighted mean over the batches of each fold's training draws and held-out rows.

    Both frames have (fold, batch, label, features); a batch holds at most ``batch_size`` rows (X6).  They are laid
    out by batch once, as a table; every scan is then one narrow pass and one aggregate.
    """
    feats, folds = list(features), list(folds)
    xs = [f"x{i}" for i in range(len(feats))]
    part = lambda df, held: df.select(F.col(fold).cast("int").alias("fold"), F.lit(held).alias("held"), F.col(batch).cast("long").alias("batch"),
                                      F.col(label).cast("int").alias("label"), *(F.col(f).cast("double").alias(x) for f, x in zip(feats, xs)))
    both = part(train, 0).unionByName(part(held_out, 1)).where(F.col("fold").isin(folds))
    stored = cut_lineage(both.repartition("fold", "held", "batch").sortWithinPartitions("fold", "held", "batch"), "batches")
    names = ["n", "loss", *(f"g{i}" for i in range(len(feats)))]

    def scan(theta: np.ndarray) -> Scan:
        w = {f: x for f, x in zip(folds, frames.raw(theta)[:, 1:])}  # differences of scores have no intercept

        def run(chunks):
            carry = None
            for pdf in chunks:
                pdf = pdf if carry is None else TR.pd.concat([carry, pdf], ignore_index=True)
                if not len(pdf):
                    continue
                key = pdf[["fold", "held", "batch"]].to_numpy()
                new = np.append(True, (key[1:] != key[:-1]).any(axis=1))
                cut = int(np.flatnonzero(new)[-1])
                done, carry = pdf.iloc[:cut], pdf.iloc[cut:]
                yield from sums(done, new[:cut])
            if carry is not None and len(carry):
                yield from sums(carry, np.append(True, np.zeros(len(carry) - 1, bool)))

        def sums(pdf, new):
            if not len(pdf):
                return
            pdf = pdf.assign(batch=np.cumsum(new))
            for (f, held), g in pdf.groupby(["fold", "held"]):
                per = TR._gradients(*TR._padded(g, xs, "batch"), w[f])
                yield TR.pd.DataFrame([(f, held, *(per[:, 0] @ per[:, 1:]), per[:, 0].sum())], columns=["fold", "held", *names[1:], "n"])

        schema = "fold int, held int, " + ", ".join(f"{c} double" for c in [*names[1:], "n"])
        each = stored.select("fold", "held", "batch", "label", *xs).mapInPandas(run, schema)
        got = {(r.fold, r.held): r for r in each.groupBy("fold", "held").agg(*(F.sum(c).alias(c) for c in names)).collect()}
        loss, held_loss, grad = np.full(len(folds), np.nan), np.full(len(folds), np.nan), np.zeros((len(folds), len(feats) + 1))
        for i, f in enumerate(folds):
            if (f, 0) in got:
                r = got[f, 0]
                loss[i], grad[i, 1:] = r.loss / r.n, np.array([r[c] for c in names[2:]]) / r.n
            if (f, 1) in got:
                held_loss[i] = got[f, 1].loss / got[f, 1].n
        return Scan(loss, held_loss, frames.gradient(grad))

    return scan


def best_models(state: DataFrame, features: Sequence[str], frames: FoldFrames, folds: Sequence[int]) -> dict[int, SW.LinearModel]:
    """The restored best weights of every fold, on unscaled features."""
    got = {r.fold: r.best_weights for r in state.collect()}
    raw = frames.raw(np.array([got[f] for f in folds]))
    return {f: SW.LinearModel(list(features), x[1:], float(x[0])) for f, x in zip(folds, raw)}
