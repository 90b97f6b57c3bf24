"""State kept up to date by arrivals, and stored moments, against one full build or scan."""
import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import moments as MO
from cohortkit.operators import upkeep as UP
from cohortkit.operators.harmonise import one_row_per_entity

SCHEMA = "Code long, dateAssess int, site_order int, row_id long, v double"
RULES = [("last", "first"), ("first", "first"), ("last", "last"), ("first", "last")]


def _visits(spark, n, seed):
    r = random.Random(seed)
    # a third of all visits are one patient's; days tie often; keys and days are missing at times
    rows = [(None if r.random() < .05 else 7 if r.random() < .33 else r.randrange(40), None if r.random() < .05 else r.randrange(6),
             r.randrange(2), i, r.random()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _set(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("rule,ties", RULES)
def test_arrivals_equal_one_build(spark, rule, ties):
    visits = _visits(spark, 600, 3)
    full = one_row_per_entity(visits, rule=rule, ties=ties).select("Code", "dateAssess", "site_order", "row_id", "v")
    state = UP.create(visits, rule=rule, ties=ties, buckets=4)
    assert _set(UP.current(spark, state)) == []
    for i in (2, 0, 1, 1):  # in any order, one of them twice
        UP.append(state, visits.where(F.col("row_id") % 3 == i))
    assert _set(UP.current(spark, state)) == _set(full)
    small = UP.compact(spark, state)
    assert spark.table(small.table).count() == full.count()
    UP.drop(spark, state)
    assert _set(UP.current(spark, small)) == _set(full)
    UP.append(small, visits.limit(0))
    # a session started later finds the folder again
    spark.sql(f"DROP TABLE {small.table}")
    assert _set(UP.current(spark, UP.attach(spark, small))) == _set(full)


def test_stored_side_is_not_shuffled(spark):
    visits = _visits(spark, 300, 4)
    state = UP.create(visits, buckets=4)
    UP.append(state, visits)
    assert "Exchange" not in UP.current(spark, state)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = UP.changes(spark, state, visits)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stored = [i for i, line in enumerate(plan.splitlines()) if "FileScan parquet" in line]
    assert len(stored) == 1
    lines = plan.splitlines()
    depth = len(lines[stored[0]]) - len(lines[stored[0]].lstrip(" :+-*"))
    for line in reversed(lines[:stored[0]]):  # upwards from the scan to the join
        d = len(line) - len(line.lstrip(" :+-*"))
        if d < depth:
            depth = d
            if "Join" in line:
                break
            assert "Exchange" not in line, line


@pytest.mark.parametrize("rule,ties", RULES[1:3])
def test_changes(spark, rule, ties):
    visits = _visits(spark, 300, 5)
    first, second = visits.where("row_id % 2 = 0"), visits.where("row_id % 2 = 1")
    state = UP.create(visits, rule=rule, ties=ties, buckets=4)
    UP.append(state, first)
    before = {r[0]: tuple(r) for r in UP.current(spark, state).collect()}
    told = {r[0]: tuple(r) for r in UP.changes(spark, state, second).collect()}
    assert UP.changes(spark, state, first).count() == 0
    UP.append(state, second)
    after = {r[0]: tuple(r) for r in UP.current(spark, state).collect()}
    assert told == {k: (*r, "replaced" if k in before else "new") for k, r in after.items() if before.get(k) != r}


def _rows(n=400, seed=1):
    r = random.Random(seed)
    return [(i, None if i % 11 == 0 else i % 3, r.gauss(5, 2), 1e7 + r.random(), 0.1, None if i % 4 else r.random(),
             1e6 * r.random() if i % 2 else r.random() * 1e-3) for i in range(n)]


FEATS = ["a", "near", "flat", "gaps", "wild"]
ORIGIN = {"near": 1e7}


def _exact(rows, by):
    """Means and population stds of exact fractions; a constant has std 1."""
    out = {}
    for k in {x[1] if by else 0 for x in rows}:
        part = [x for x in rows if not by or x[1] == k]
        out[k] = [len(part)]
        for j in range(2, 7):
            v = [x[j] for x in part if x[j] is not None]
            sd = math.sqrt(statistics.pvariance(map(Fraction, v))) if v else None
            out[k] += [float(sum(map(Fraction, v)) / len(v)) if v else None, 1.0 if sd == 0 else sd]
    return out


def _equal(got, want):
    assert got.keys() == want.keys()
    for k, values in want.items():
        for x, y in zip(got[k], values, strict=True):
            assert x == y or math.isclose(x, y, rel_tol=1e-9), (k, got[k], values)


@pytest.mark.parametrize("by,gone", [(["g"], lambda i: i % 7 == 0), (["g"], lambda i: i > 6), (["g"], lambda i: i % 2 == 1),
                                     (["g"], lambda i: False), (["g"], lambda i: i % 3 == 1 and i % 11 > 0), ([], lambda i: i % 2 == 1), ([], lambda i: True)])
def test_moments_added_and_withdrawn(spark, by, gone):
    rows = _rows()
    frame = lambda x: spark.createDataFrame(x, "id long, g int, a double, near double, flat double, gaps double, wild double").coalesce(2)
    values = lambda m: {r[0] if by else 0: list(r[len(by):]) for r in MO.scaler(m, FEATS, by).collect()}
    total = MO.add(MO.scan(frame(rows[:150]), FEATS, by, ORIGIN), MO.scan(frame(rows[150:]), FEATS, by, ORIGIN), by).cache()
    left, out = [x for x in rows if not gone(x[0])], [x for x in rows if gone(x[0])]
    less = MO.remove(total, MO.scan(frame(out), FEATS, by, ORIGIN), by).cache()
    _equal(values(MO.settle(total, frame(rows), FEATS, by, ORIGIN)), _exact(rows, by))
    _equal(values(MO.settle(less, frame(left), FEATS, by, ORIGIN)), _exact(left, by))
    total.unpersist()
    less.unpersist()


def test_origins_may_differ(spark):
    a, b = (spark.createDataFrame([(v,) for v in x], "x double") for x in ([1.0, 4.0], [7.0, 10.0]))
    both = MO.add(MO.scan(a, ["x"], origin={"x": 2.0}), MO.scan(b, ["x"], origin={"x": -8.0})).cache()
    assert tuple(MO.scaler(both, ["x"]).first()) == (4, 5.5, pytest.approx(math.sqrt(11.25), rel=1e-12))
    assert tuple(MO.scaler(MO.remove(both, MO.scan(a, ["x"])), ["x"]).first()) == (2, 8.5, pytest.approx(1.5, rel=1e-9))


def test_cancelled_groups_are_read_again_others_not(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(i, i % 2, (1e8 * r.random() if i >= 20 else r.random()) if i % 2 else r.gauss(0, 1)) for i in range(400)],
                                 "id long, g int, x double")
    total = MO.scan(rows, ["x"], ["g"])
    less = MO.remove(total, MO.scan(rows.where("id >= 20 and (g = 1 or id < 60)"), ["x"], ["g"]), ["g"])
    assert {x.g: x.stale for x in less.collect()} == {0: False, 1: True}


def test_values_without_moments(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, 1, 2.0), (2, 1, nan), (3, 1, 5.0), (4, 2, inf), (5, 2, 1.0), (6, 2, 4.0), (7, 3, None)], "id int, g int, x double")
    bad = rows.where("id in (2, 4)")
    less = MO.remove(MO.scan(rows, ["x"], ["g"]), MO.scan(bad, ["x"], ["g"]), ["g"]).cache()
    got = {r.g: r for r in MO.scaler(MO.settle(less, rows.where("id not in (2, 4)"), ["x"], ["g"]), ["x"], ["g"]).collect()}
    assert (got[1].mean_x, got[1].std_x, got[2].mean_x, got[2].std_x) == (3.5, 1.5, 2.5, 1.5)
    assert (got[3].n_train, got[3].mean_x) == (1, None)
    empty = MO.scan(rows.limit(0), ["x"], ["g"])
    assert MO.add(empty, empty, ["g"]).count() == 0 and MO.remove(empty, empty, ["g"]).count() == 0
    less.unpersist()


def test_part_that_is_no_part_is_stale(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 3.0)], "g int, x double")
    more = spark.createDataFrame([(1, 2.0), (1, 3.0), (1, 9.0)], "g int, x double")
    assert MO.remove(MO.scan(rows, ["x"], ["g"]), MO.scan(more, ["x"], ["g"]), ["g"]).first().stale
