"""Small-frame tests for follow-up thresholds, per-patient reduction and dates."""
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import harmonise as H
from cohortkit.operators import visits as V


def test_followup_boundary_strict_vs_inclusive(spark):
    df = spark.createDataFrame([(1, 5 * 365, 1), (2, 5 * 365 + 1, 1), (3, 5 * 365 - 1, 1), (4, 10 * 365, 0)],
                               "Code long, dateAssess int, Eskd int")
    rows = {r.years: r for r in V.events_by_followup(df, [0, 5, 10]).collect()}
    assert (rows[5].events_strict, rows[5].events_inclusive, rows[5].patients_inclusive) == (1, 2, 3)
    assert (rows[0].events_strict, rows[0].events_inclusive) == (3, 3)
    assert (rows[10].events_strict, rows[10].events_inclusive, rows[10].patients_inclusive) == (0, 0, 1)


def test_one_row_per_entity_ties(spark):
    rows = [(1, 100, 0, 5, "a"), (1, 100, 0, 3, "b"), (1, 90, 0, 1, "c"), (2, None, 0, 1, "d"), (2, 7, 1, 9, "e"),
            (None, 500, 0, 1, "z")]
    df = spark.createDataFrame(rows, "Code long, dateAssess int, site_order int, row_id long, v string")
    pick = lambda **kw: {r.Code: r.v for r in H.one_row_per_entity(df, columns=["v"], **kw).collect()}
    assert pick(rule="last", ties="first") == {1: "b", 2: "e"}      # idxmax: first row in sheet order
    assert pick(rule="last", ties="last") == {1: "a", 2: "e"}       # sort + tail(1): last row wins
    assert pick(rule="first", ties="first") == {1: "c", 2: "e"}     # NULL dates never win


def test_dates_strict_and_lenient(spark):
    base = {"VALIGA_CODE": 1, "row_id": 1, "Gender1M2F": 1, "age": 30.5, "M": 0, "E": 0, "S": 0, "T": 0, "C": 0,
            "AceiYN": "Y", "Fishoil": "N", "CELLCEPT": "0", "AZA": "N", "CsIm": "N", "ESKDcorretto": "1",
            "creat_mgdl_last": "2", "uprot_gday_last": "1", "DBPlast": "80", "SBPlast": "120"}
    good = dict(base, RBdate="01/02/2000", Lastvisit="01/03/2000")
    bad = dict(base, row_id=2, RBdate="31/02/2000", Lastvisit="01/03/2000")
    df = spark.createDataFrame([good, bad])
    lenient = {r.row_id: r.dateAssess for r in H.clean_site_a(df, "max", lenient_dates=True).collect()}
    assert lenient == {1: 29, 2: None}
    with pytest.raises(Exception):
        H.clean_site_a(df, "max", lenient_dates=False).collect()
    one = H.clean_site_a(spark.createDataFrame([good]), "max").first()
    assert (one.Hypertension, one.Antihypertensive, one.Eskd, one.Gender) == (1, 1, 1, "M")
