"""Stacked sweeps, training loops with early stopping, networks of all folds in one scan."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import loop as LP
from cohortkit.operators import networks as NW
from cohortkit.operators import sweep as SW
from cohortkit.operators import training as TR
from cohortkit.plans import sweep as PS
from cohortkit.plans import training as PT
from cohortkit.session import cut_lineage

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """900 rows in five folds with overlapping classes, unequal scales, a constant and dependent column."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2)) * [1.0, 40.0] + [0.0, 300.0]
    y = (x[:, 0] + (x[:, 1] - 300) / 40 + rng.normal(size=900) * 2 > 0.8).astype(int)
    data = [(i, int(y[i]), int(i * 7 % 5 + 1), float(x[i, 0]), float(x[i, 1]), 3.0) for i in range(900)]
    df = spark.createDataFrame(data, "Code long, label int, fold long, a double, b double, c double")
    return cut_lineage(TR.with_pos_weight(df, "label"))


def test_coefficients_equal_separate_fits(rows):
    sweep = SW.fit_logistic_sweep(rows, FEATS, (0.0, 0.01, 0.3), range(1, 6))
    assert sweep.scans < 12
    for reg in (0.0, 0.01, 0.3):
        lr = TR.weighted_logistic().setTol(1e-14).setMaxIter(1000).setRegParam(reg)
        for f, m in TR.fit_folds(rows, TR.classifier_pipeline(lr, FEATS), (1, 4)).items():
            _, w, b = TR.linear_parts(m)
            got = sweep.models[f, reg]
            assert np.abs(w - got.weights).max() < 1e-6 and abs(b - got.intercept) < 1e-6 * max(1, abs(b))


def test_fold_zero_is_the_fit_on_all_rows(rows):
    got = SW.fit_logistic_sweep(rows, FEATS[:2], (0.01,), [0]).models[0, 0.01]
    lr = TR.weighted_logistic().setTol(1e-14).setMaxIter(1000).setRegParam(0.01)
    _, w, b = TR.linear_parts(TR.classifier_pipeline(lr, FEATS[:2]).fit(rows))
    assert np.abs(w - got.weights).max() < 1e-6 and abs(b - got.intercept) < 1e-5


def test_a_step_is_one_scan(rows):
    slim = cut_lineage(SW.usable_rows(rows, FEATS, "label", "weight", "fold"))
    plan = SW.model_sums(slim, SW.Frame(np.zeros(3), np.ones(3)), np.zeros((10, 4)), np.repeat(np.arange(1, 6), 2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_incomplete_rows_and_dependent_features(spark, rows):
    """Null or NaN cells leave a row out; a doubled column shares the weight; a null fold trains everywhere."""
    bad = spark.createDataFrame([(1, 1, 1, None, 1.0, 3.0, 1.0), (2, None, 1, 1.0, 1.0, 3.0, 1.0), (3, 1, 1, float("nan"), 1.0, 3.0, 1.0)], rows.schema)
    a = SW.fit_logistic_sweep(rows, FEATS[:2], (0.0,), [2]).models[2, 0.0]
    b = SW.fit_logistic_sweep(rows.union(bad), FEATS[:2], (0.0,), [2]).models[2, 0.0]
    assert np.allclose(a.weights, b.weights, atol=1e-9)
    twice = SW.fit_logistic_sweep(rows.withColumn("d", 2 * F.col("a") + 1), ["a", "d", "b"], (0.0,), [2]).models[2, 0.0]
    assert abs(twice.weights[0] + 2 * twice.weights[1] - a.weights[0]) < 1e-6
    free = rows.withColumn("fold", F.when(F.col("fold") != 2, F.col("fold")))
    c = SW.fit_logistic_sweep(free, FEATS[:2], (0.0,), [2]).models[2, 0.0]
    d = SW.fit_logistic_sweep(rows, FEATS[:2], (0.0,), [0]).models[0, 0.0]
    assert np.allclose(c.weights, d.weights, atol=1e-8)


def test_separable_classes_end(spark):
    df = spark.createDataFrame([(i, int(i > 20), i % 2 + 1, float(i)) for i in range(40)], "Code long, label int, fold long, a double")
    s = SW.fit_logistic_sweep(df, ["a"], (0.0, 0.1), [1, 2], weight=None)
    assert s.scans <= 30 and s.losses[1, 0.0] < 1e-4 and s.losses[1, 0.1] > 0.01


def test_grid_choice_and_scores(rows):
    sweep = SW.fit_logistic_sweep(rows, FEATS, (0.0, 5.0), range(1, 6))
    auc = SW.grid_metrics(rows, sweep)
    assert auc.count() == 10 and all(r.auc > 0.6 for r in auc.collect())
    one = SW.score_models(rows, sweep.models, "s", keep=("Code",), own_fold="fold").where("reg = 0.0 AND Code = 17").first()
    r, m = rows.where("Code = 17").first(), sweep.models[one.fold, 0.0]
    assert r.fold == one.fold and abs(one.s - (m.intercept + sum(w * r[f] for f, w in zip(m.features, m.weights)))) < 1e-9


# --- loop ---------------------------------------------------------------------

RULE = LP.Rule(check_every=3, patience=2, min_delta=1e-3, max_epochs=40)


def run(rows, folder, scan, start, stop_after=None, rule=RULE):
    return LP.train_loop(rows.sparkSession, folder, "r", range(1, 6), start, scan, rule, 0.8, stop_after)


@pytest.fixture(scope="module")
def logistic(rows):
    return LP.logistic_scan(rows, FEATS[:2], range(1, 6), LP.fold_frames(rows, FEATS[:2], range(1, 6)))


def by_fold(df):
    return {r.fold: r for r in df.collect()}


def test_replay_over_own_log_equals_the_loop(spark, rows, logistic, tmp_path):
    folder = str(tmp_path / "a")
    state = run(rows, folder, logistic, np.zeros((5, 3)))
    got = {r.fold: tuple(r)[1:] for r in PS.loop_result(spark, folder, state, RULE).collect()}
    assert got == {r.fold: tuple(r)[1:] for r in PS.replayed(spark, folder, RULE).collect()}
    assert any(v[3] is not None for v in got.values())
    log = LP.read_log(spark, folder, RULE)
    assert log.count() == log.select("fold", "epoch", "metric").distinct().count()
    assert all(r.n == got[r.fold][4] for r in log.where("metric = 'loss'").groupBy("fold").agg(F.count("*").alias("n")).collect())


def test_killed_run_resumes_to_the_same_weights(spark, rows, logistic, tmp_path):
    whole, parts = str(tmp_path / "w"), str(tmp_path / "p")
    want = by_fold(run(rows, whole, logistic, np.zeros((5, 3))))
    for cut in (2, 5, 9, 1):  # before the first check, on one, between two, at once
        run(rows, parts, logistic, np.zeros((5, 3)), stop_after=cut)
    got = by_fold(run(rows, parts, logistic, np.zeros((5, 3))))
    for f, r in want.items():
        assert np.allclose(r.weights, got[f].weights, atol=1e-12) and np.allclose(r.best_weights, got[f].best_weights, atol=1e-12)
        assert tuple(r)[3:] == pytest.approx(tuple(got[f])[3:]) if r.stop_epoch else r.best_epoch == got[f].best_epoch
    keys = ["fold", "epoch", "metric"]
    a, b = (LP.read_log(spark, x, RULE) for x in (whole, parts))
    assert a.count() == b.count() == a.join(b, keys).where(F.abs(a.value - b.value) < 1e-12).count()


def test_best_weights_are_those_of_the_best_check(rows, logistic, tmp_path):
    """Steps that overshoot: the loss rises again, the restored weights are the earlier ones."""
    folder = str(tmp_path / "o")
    scale = {"n": 0}

    def scan(theta):
        scale["n"] += 1
        s = logistic(theta)
        return LP.Scan(s.loss, s.held_loss, s.grad if scale["n"] < 8 else -s.grad)  # from then on uphill

    state = by_fold(run(rows, folder, scan, np.zeros((5, 3))))
    folds = sorted(state)
    best = np.array([state[f].best_weights for f in folds])
    held = logistic(best).held_loss
    assert np.allclose(held, [state[f].best_loss for f in folds])
    assert all(r.best_epoch < r.stop_epoch for r in state.values())


def test_logistic_scan_is_the_gradient(rows, logistic):
    rng = np.random.default_rng(1)
    theta, e = rng.normal(size=(5, 3)), 1e-5
    s = logistic(theta)
    for j in range(3):
        step = np.zeros((5, 3))
        step[:, j] = e
        slope = (logistic(theta + step).loss - logistic(theta - step).loss) / (2 * e)
        assert np.allclose(slope, s.grad[:, j], atol=1e-7)


def test_pairwise_scan_against_all_pairs(spark, rows):
    frames = LP.fold_frames(rows, FEATS[:2], range(1, 6))
    draws = rows.select(F.explode(F.array(*(F.lit(f) for f in range(1, 6)))).alias("f"), "*").where("f <> fold").select(
        F.col("f").alias("fold"), (F.col("Code") % 31).alias("batch_id"), "label", "a", "b")
    held = rows.withColumn("batch_id", F.col("Code") % 7)
    theta = np.random.default_rng(3).normal(size=(5, 3))
    got = LP.pairwise_scan(draws, held, FEATS[:2], range(1, 6), frames)(theta)
    for what, p in (("loss", draws.toPandas()), ("held_loss", held.toPandas())):
        for i, w in enumerate(frames.raw(theta)[:, 1:]):
            total = n = 0
            for _, g in p[p.fold == i + 1].groupby("batch_id"):
                s = g[["a", "b"]].to_numpy() @ w
                d = s[g.label == 0][:, None] - s[g.label == 1][None, :]
                total += len(g) * (np.logaddexp(0, d).mean() if d.size else 0.0)
                n += len(g)
            assert abs(getattr(got, what)[i] - total / n) < 1e-9


def test_rows_of_the_real_fits(spark, sf, tmp_path):
    folder = str(tmp_path / "pair")
    state, frames, test = PS.pairwise_loop(spark, sf, folder, LP.Rule(5, 2, 1e-3, 10))
    assert state.count() == 10
    got = {r.fold: tuple(r)[1:] for r in PS.loop_result(spark, folder, state, LP.Rule(5, 2, 1e-3, 10)).collect()}
    assert got == {r.fold: tuple(r)[1:] for r in PS.replayed(spark, folder, LP.Rule(5, 2, 1e-3, 10)).collect()}
    models = LP.best_models(state, PS.FEATS, frames, PS.FOLDS)
    from cohortkit.operators import metrics as MT
    auc = MT.auc(TR.score_folds(test, models, "score", keep=PT.ROW), "label", "score", ["fold"]).collect()
    assert np.mean([r.auc for r in auc]) > 0.6


# --- networks -----------------------------------------------------------------

def test_networks_equal_transform_in_one_scan(rows):
    feats = FEATS[:2]
    models = TR.fit_folds(rows, TR.classifier_pipeline(TR.mlp(2, hidden=(7, 5), max_iter=15), feats), (1, 2, 3))
    scored = NW.score_networks(rows, models, feats, "prob", ("Code", "label"))
    got = {(r.fold, r.Code): r.prob for r in scored.collect()}
    for f, m in models.items():
        for r in TR.probability_of_one(m.transform(rows)).select("Code", "prob").collect():
            assert abs(got[f, r.Code] - r.prob) < 1e-9
    assert len(got) == 3 * 900 and scored._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_blocks_give_the_sums_of_their_rows(spark):
    """The loop's table has one binary value for up to 64 rows; a pass over it adds up what one over the rows does."""
    from cohortkit.operators import sweep
    rng = np.random.default_rng(3)
    data = [(*map(float, rng.normal(size=3)), float(rng.integers(0, 2)), float(rng.random()), int(rng.integers(0, 5))) for _ in range(1000)]
    rows = spark.createDataFrame(data, "x0 double, x1 double, x2 double, y double, w double, fold int").repartition(3)
    frame = sweep.Frame(np.array([0.1, 0.2, 0.3]), np.array([1.0, 2.0, 0.5]))
    theta, held = rng.normal(size=(5, 4)), np.arange(5)
    packed = sweep.blocks(rows)
    assert packed.columns == ["block"] and packed.count() < 1000 / 64 + 3 * spark.sparkContext.defaultParallelism
    a, b = (sweep.collect_sums(sweep.model_sums(x, frame, theta, held), 5, 4) for x in (rows, packed))
    for name in ("loss", "held_loss", "grad", "gram"):
        np.testing.assert_allclose(getattr(a, name), getattr(b, name), rtol=1e-12, atol=1e-12)
    none = sweep.collect_sums(sweep.model_sums(sweep.blocks(rows.limit(0)), frame, theta, held), 5, 4)
    assert not none.loss.any() and np.isnan(none.held_loss).all()
