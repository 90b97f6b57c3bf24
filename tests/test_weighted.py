"""X5 by row weight, X6 by epoch, absolute loss, plans without build-time jobs."""
import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import features as FT
from cohortkit.operators import lad as LD
from cohortkit.operators import weighted as WT


def u60(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def drawn(rows, seed):
    """Every draw by a walk along the line of weights."""
    order = sorted(rows, key=lambda r: (hashlib.md5(f"{seed}|row|{r[0]}".encode()).hexdigest(), r[0]))
    units = [(k, round(w) if w is not None and w == w and w > 0 else 0) for k, w in order]
    total, out = sum(u for _, u in units), []
    for i in range(len(units) if total else 0):
        p = u60(f"{seed}|w|{i}") * total >> 60
        for k, u in units:
            if p < u:
                out.append((i, k))
                break
            p -= u
    return sorted(out)


@pytest.mark.parametrize("weights", [
    [1.0] * 50, [None, 0.0, -3.0, float("nan"), 2.0, 5.0], [1.0] * 300 + [1e9], [1e17, 1.0, 3.0] * 20, [0.0, None], [7.0], list(range(400)), []])
def test_weighted_draws(spark, weights):
    rows = [(i, None if w is None else float(w)) for i, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "Code long, w double")
    for parts in (1, 5):
        got = WT.weighted_draws(df.repartition(parts), "Code", "w", 9, slices=16).collect()
        assert sorted((r.draw_id, r.Code) for r in got) == drawn(rows, 9)


def test_weight_beyond_the_line_is_an_error(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, 1.0)], "Code long, w double")
    with pytest.raises(Exception, match="(?i)overflow|out of range|NUMERIC_VALUE|CAST"):
        WT.weighted_draws(df, "Code", "w").collect()


def test_every_epoch_is_a_bijection(spark):
    for n in (1, 2, 3, 7, 16, 17, 90, 101, 1000):
        df = spark.range(n).select(F.col("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("epoch"))
        got = df.select("epoch", "id", WT.permuted(F.col("id"), F.lit(n).cast("long"), 5, F.col("epoch")).alias("p")).collect()
        for e in (1, 2):
            assert sorted(r.p for r in got if r.epoch == e) == list(range(n))
        if n > 50:
            assert sum(a.p == b.p for a, b in zip(*([r for r in got if r.epoch == e] for e in (1, 2)))) < n / 4


def test_epoch_batches(spark):
    df = spark.range(203).select((F.col("id") * 7).alias("Code"))
    got = [sorted(map(tuple, WT.epoch_batches(df.repartition(p), "Code", 3, 4, 32).collect())) for p in (1, 6)]
    assert got[0] == got[1] and len(got[0]) == 4 * 203
    assert {(r[1], r[3]) for r in got[0]} == {(e, b) for e in range(1, 5) for b in range(7)}


def test_absolute_loss_is_the_least(spark):
    """One feature: the best line goes through two points; all of them are tried."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=60) * 3 + 5
    y = 2 * x + rng.standard_cauchy(60) + 1
    df = spark.createDataFrame([(float(a), float(b), i % 3 + 1) for i, (a, b) in enumerate(zip(x, y))], "a double, target double, fold long")
    for f, g in LD.fit_absolute(df, ["a"], [1, 2, 3]).items():
        on = np.arange(60) % 3 + 1 != f
        px, py = x[on], y[on]
        best = min(np.abs(py - py[i] - (py[j] - py[i]) / (px[j] - px[i]) * (px - px[i])).mean() for i, j in itertools.combinations(range(len(px)), 2))
        assert g.n == 40 and best - 1e-9 <= g.loss <= best + 1e-5 and g.loss - g.gap <= best + 1e-9 and g.subgradient < 1e-5
    for f, g in LD.fit_absolute(df, [], [0, 2]).items():
        on = np.arange(60) % 3 + 1 != f
        assert abs(g.loss - np.abs(y[on] - np.median(y[on])).mean()) < 1e-6


def test_unit_detection_starts_no_job(spark):
    df = spark.createDataFrame([(400,), (None,), (30,)], "d int")
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        out = FT.to_years(df, "d")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.d for r in out.collect()] == [400 / 365.25, None, 30 / 365.25]
    assert [r.d for r in FT.to_years(df.where("d < 50"), "d").collect()] == [30.0]
