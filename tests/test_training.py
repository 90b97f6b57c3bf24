"""ML operators: row counts and 'better than random' thresholds."""
import __spark_entry__ as E
from cohortkit.operators import metrics as MT


def test_cv_logistic_beats_random(spark, sf):
    rows = E.queries()["cv_logistic"](spark, sf).collect()
    assert len(rows) == 10
    aucs = [r.auc for r in rows if r.auc is not None]
    assert sum(aucs) / len(aucs) > 0.6


def test_pairwise_ranker_beats_random(spark, sf):
    from cohortkit.plans.training import ranker_scores
    df = ranker_scores(spark, sf)
    a = MT.auc(df, "label", "score").first().auc
    assert a > 0.6


def test_time_regressor_rows(spark, sf):
    rows = E.queries()["time_regressor"](spark, sf).collect()
    assert sorted((r.kind, r.fold) for r in rows) == [(k, f) for k in ("gbt", "linear") for f in range(1, 11)]
    assert all(r.mae >= 0 for r in rows) and len({r.n for r in rows}) == 1


def test_regressors_fit_in_full_tasks(spark, sf, monkeypatch):
    """Few rows in many partitions are fitted in few tasks, all of them, with the same models."""
    from cohortkit.operators import training as TR
    from cohortkit.plans import training as PT
    train = PT.regression_rows(spark, sf)[0].repartition(16)
    n, seen, fit_folds = train.count(), [], TR.fit_folds

    def spy(rows, *args, **kwargs):
        seen.append((rows.rdd.getNumPartitions(), rows.count()))
        return fit_folds(rows, *args, **kwargs)

    monkeypatch.setattr(TR, "fit_folds", spy)
    models = PT.regressors(train, "linear", ["Age"])
    assert seen == [(1, n)]
    monkeypatch.setattr(PT, "FIT_ROWS", -(-n // 4))
    PT.regressors(train, "linear", ["Age"])
    assert seen[1] == (4, n)
    for f in (1, 7):
        own = models[f].stages[-1]
        whole = TR.linear_parts(TR.fit_folds(train, PT.Pipeline(stages=models[f].stages[:2] + [TR.time_regressor("linear")]), [f])[f])
        assert own.coefficients.size == 1 and abs(TR.linear_parts(models[f])[1][0] - whole[1][0]) < 1e-9


def test_every_fold_scores_the_test_set(spark, sf):
    rows = E.queries()["eval_all_folds"](spark, sf).collect()
    assert sorted((r.fold, r.years) for r in rows) == [(f, y) for f in range(1, 11) for y in (0, 5, 10)]
    assert len({r.n for r in rows if r.years == 0}) == 1


def test_fold_without_artifact_is_skipped(spark, sf, tmp_path):
    from cohortkit.operators import training as TR
    from cohortkit.plans import training as PT
    models, _, _ = PT.saturated_fit(spark, sf)
    for f in (2, 5):
        TR.save_model(models[f], str(tmp_path / f"fold={f}"))
    assert sorted(TR.load_fold_models(spark, str(tmp_path), range(1, 11))) == [2, 5]


def test_linear_parts_equal_transform(spark, sf):
    """The columns made of a fold's model give the model's own probabilities."""
    from cohortkit.operators import training as TR
    from cohortkit.plans import training as PT
    models, _, test = PT.cv_fit(spark, sf, grid=(0.01,))
    own = {r.Code: r.prob for r in TR.probability_of_one(models[4].transform(test)).collect()}
    got = {r.Code: r.prob for r in PT.test_scores({4: models[4]}, test).collect()}
    assert own.keys() == got.keys() and all(abs(own[c] - got[c]) < 1e-9 for c in own)


def test_score_best_fold_three_thresholds(spark, sf):
    rows = E.queries()["score_best_fold"](spark, sf).collect()
    assert sorted(r.years for r in rows) == [0, 5, 10]


def test_scaler_pipeline_roundtrip(spark, sf, tmp_path):
    from cohortkit.operators import training as TR
    from cohortkit.plans.features import split_features
    from cohortkit.operators import splits as SP
    s = split_features(spark, sf)
    train = TR.with_pos_weight(SP.train_rows(s), "label")
    m = TR.classifier_pipeline(TR.weighted_logistic()).fit(train)
    TR.save_model(m, str(tmp_path / "m"))
    m2 = TR.load_model(str(tmp_path / "m"))
    a = TR.probability_of_one(m.transform(SP.test_rows(s))).select("Code", "prob").orderBy("Code").collect()
    b = TR.probability_of_one(m2.transform(SP.test_rows(s))).select("Code", "prob").orderBy("Code").collect()
    assert [round(x.prob, 9) for x in a] == [round(x.prob, 9) for x in b]


def test_feature_order_metadata(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from cohortkit.operators import features as FT
    from cohortkit.operators import training as TR
    from cohortkit.plans.features import features
    v = VectorAssembler(inputCols=FT.FEATURES, outputCol="features").transform(features(spark, sf))
    assert TR.feature_order(v) == FT.FEATURES


def test_ranker_gradients_stream_across_chunks(spark):
    """Per-batch gradients are the same when batches straddle Arrow chunks."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F
    from cohortkit.operators import training as TR
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"batch_id": np.repeat(np.arange(40), 32)[:1200], "label": rng.integers(0, 2, 1200),
                        "a": rng.normal(size=1200), "b": rng.normal(size=1200)})
    w = np.array([0.3, -0.2])
    exp = {}
    for b, g in pdf.groupby("batch_id"):
        x, y = g[["a", "b"]].to_numpy(), g["label"].to_numpy()
        pairs = [(n - p, 1 / (1 + np.exp(-((n - p) @ w)))) for n in x[y == 0] for p in x[y == 1]]
        exp[b] = np.mean([np.log1p(np.exp(d @ w)) for d, _ in pairs]), np.mean([sig * d for d, sig in pairs], axis=0)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(pdf).repartition(3, "batch_id").sortWithinPartitions("batch_id")
        out = df.mapInPandas(TR._partition_gradients(["a", "b"], "batch_id", w),
                             "n long, loss double, g0 double, g1 double").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sum(r.n for r in out) == 1200 and len(out) == pdf.batch_id.nunique()
    got = sorted((round(r.loss, 9), round(r.g0, 9), round(r.g1, 9)) for r in out)
    want = sorted((round(l, 9), round(g[0], 9), round(g[1], 9)) for l, g in exp.values())
    assert got == want


def test_cross_validation_works_out_its_rows_once(spark):
    """Grid x folds give the sub-models and metrics of ``CrossValidator``, on rows that are stored first."""
    import numpy as np
    import pytest
    from pyspark.ml.tuning import CrossValidator
    from pyspark.sql import functions as F
    from cohortkit.operators import training as TR
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 2))
    rows = [(*map(float, r), int(r[0] + n > 0), i % 3 + 1) for i, (r, n) in enumerate(zip(x, rng.normal(size=240)))]
    df = TR.with_pos_weight(spark.createDataFrame(rows, "a double, b double, label int, fold long"))
    lr = TR.weighted_logistic()
    pipe, grid = TR.classifier_pipeline(lr, ["a", "b"]), TR.logistic_grid(lr, (0.0, 0.1))
    ev = TR.BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", numBins=0)
    own = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=3, foldCol="_f", collectSubModels=True).fit(
        df.withColumn("_f", (F.col("fold") - 1).cast("int")))

    seen = spark.sparkContext.accumulator(0)

    def count(label):
        seen.add(1)
        return label

    counted = df.withColumn("label", F.udf(count, "int")("label"))
    got = TR.cross_validate(counted, pipe, grid, k=3)
    assert seen.value == 240
    assert np.allclose(got.avgMetrics, own.avgMetrics, atol=1e-9)
    for a, b in zip(got.subModels, own.subModels):
        for m, n in zip(a, b):
            assert np.allclose(m.stages[-1].coefficients.toArray(), n.stages[-1].coefficients.toArray(), atol=1e-6)
    with pytest.raises(ValueError):
        TR.cross_validate(df, pipe, grid, k=2)
