"""Missing-value and coding rules on small frames."""
import math

from pyspark.sql import functions as F

from cohortkit.functions import recode as R


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_hypertension_never_true_from_missing(spark):
    df = spark.createDataFrame(
        [(1, "150", "80", "N"), (2, "NaN", "NaN", None), (3, "n/a", "", "1"), (4, None, "95", None),
         (5, "120", "70", "Y")], "id int, s string, d string, t string")
    out = df.select("id", R.hypertension("s", "d", "t").alias("h")).orderBy("id")
    assert _rows(out, "id", "h") == [(1, 1), (2, 0), (3, 0), (4, 1), (5, 1)]


def test_to_double_coerces_junk_and_nan_to_null(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("",), ("NaN",), (None,)], "x string")
    vals = [r["v"] for r in df.select(R.to_double("x").alias("v")).collect()]
    assert vals == [1.5, None, None, None, None]


def test_or_of_flags_propagates_null(spark):
    df = spark.createDataFrame([(0, 0, None), (1, None, 0), (0, 0, 0), (0, 1, 0)], "a int, b int, c int")
    vals = [r["v"] for r in df.select(R.any_flag_strict("a", "b", "c").alias("v")).collect()]
    assert vals == [None, None, 0, 1]


def test_row_max_skips_null_and_nan(spark):
    df = spark.createDataFrame([(None, 1.0, None), (float("nan"), 0.0, None), (None, None, None)],
                               "a double, b double, c double")
    vals = [r["v"] for r in df.select(R.any_therapy_max("a", "b", "c").alias("v")).collect()]
    assert vals == [1.0, 0.0, None]


def test_round_half_even(spark):
    df = spark.createDataFrame([(20.5,), (21.5,), (22.25,), (-0.5,)], "a double")
    assert [r["v"] for r in df.select(R.round_half_even("a").alias("v")).collect()] == [20, 22, 22, 0]


def test_fill_invalid(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (2.5,)], "x double")
    assert [r["v"] for r in df.select(R.fill_invalid("x").alias("v")).collect()] == [0.0, 0.0, 0.0, 0.0, 2.5]


def test_recode_type_aware(spark):
    num = spark.createDataFrame([(1,), (2,), (3,), (None,)], "g int")
    assert [r["v"] for r in num.select(R.gender(num, "g").alias("v")).collect()] == ["M", "F", None, None]
    txt = spark.createDataFrame([("Y",), ("1",), ("N",), ("0",), ("maybe",), (None,)], "t string")
    assert [r["v"] for r in txt.select(R.yes_no(txt, "t", "A").alias("v")).collect()] == [1, 1, 0, 0, None, None]
    b = spark.createDataFrame([("Yes",), ("No",), ("Y",)], "t string")
    assert [r["v"] for r in b.select(R.yes_no(b, "t", "B").alias("v")).collect()] == [1, 0, 1]


def test_sex_encodings(spark):
    df = spark.createDataFrame([("M",), ("F",), ("X",), (None,), ("m",)], "s string")
    rep = [r["v"] for r in df.select(R.sex_to_number(df, "s", "M0F1").alias("v")).collect()]
    assert rep == [0.0, 1.0, None, None, None]
    mp = [r["v"] for r in df.select(R.sex_to_number(df, "s", "M1F0").alias("v")).collect()]
    assert mp == [1.0, 0.0, None, None, None]
    anyc = [r["v"] for r in df.select(R.sex_to_number(df, "s", "M0F1_any_case").alias("v")).collect()]
    assert anyc == [0.0, 1.0, None, None, 0.0]


def test_positive_flag_missing_is_zero(spark):
    df = spark.createDataFrame([("2",), ("0",), ("-",), (None,)], "n string")
    assert [r["v"] for r in df.select(R.positive_flag("n").alias("v")).collect()] == [1, 0, 0, 0]


def test_therapy_sum_requires_some_column(spark):
    import pytest
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        R.any_therapy_sum(df, ["a", "b"])


def test_undefined_rates_are_zero(spark):
    from cohortkit.operators import metrics as MT
    cm = spark.createDataFrame([(10, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    r = MT.rates(cm).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert not math.isnan(r.f1)


def test_missing_and_nan_scores(spark):
    from pyspark.sql import functions as F

    from cohortkit.operators import history as HS
    from cohortkit.operators import metrics as MT
    nan = float("nan")
    df = spark.createDataFrame([(1, None), (2, nan), (3, -4.0), (4, 99.0)], "id int, x double")
    rows = df.select(MT.clamp("x").alias("c"), MT.classify("x").alias("k")).collect()
    assert [r.c for r in rows] == [None, None, 0.0, 10.0] and [r.k for r in rows] == [None, 0, 0, 1]
    log = spark.createDataFrame([(1, 1, 0.3, 0.5), (1, 2, nan, nan), (1, 3, None, 0.9), (2, 1, nan, nan)],
                                "run_id long, epoch long, val_loss double, val_f1 double")
    best = {r.run_id: r.best_epoch for r in HS.best_epoch(log).collect()}
    assert best == {1: 3, 2: None}
    assert HS.best_epoch(log, metric="val_loss", mode="min").where("run_id = 1").first().best_epoch == 1
    folds = spark.createDataFrame([(1, nan), (2, 0.4), (3, None)], "fold long, f1 double")
    assert HS.best_fold(folds, F.col("f1")).first().fold == 2
    cur = spark.createDataFrame([(1, nan), (2, 0.2)], "k long, f1 double")
    old = spark.createDataFrame([(2, nan)], "k long, f1 double")
    assert {r.k: r.improved for r in HS.previous_best(cur, old, "k", "f1").collect()} == {1: 0, 2: 1}


def test_run_without_a_check(spark):
    from cohortkit.operators import history as HS
    log = spark.createDataFrame([(1, 5, 0.3), (2, 1, 0.4)], "run_id long, epoch long, val_loss double")
    got = {r.run_id: (r.n_checks, r.best_epoch, r.best_loss, r.stop_epoch, r.last_epoch) for r in HS.early_stop(log, check_every=5).collect()}
    assert got == {1: (1, 5, 0.3, None, 5), 2: (0, None, None, None, 1)}


def test_threshold_zero_keeps_all_rows(spark):
    from cohortkit.operators import metrics as MT
    df = spark.createDataFrame([(1, 0.9, None), (0, 0.1, -3), (1, 0.4, 2000), (0, 0.6, 4000)], "y int, prob double, days int")
    n = {r.years: r.n for r in MT.metrics_by_followup(df, "y", "prob", "days", (0, 5, 10), by=[]).collect()}
    assert n == {0: 4, 5: 2, 10: 1}
