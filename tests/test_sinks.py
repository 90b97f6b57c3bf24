"""Sinks write and read back; missing previous-best file is an empty table."""
import json

from cohortkit.plans import evaluation as EV
from cohortkit.plans.cohort import cohort, site_a
from cohortkit.sources import sinks as SK


def test_cohort_and_sites_roundtrip(spark, sf, tmp_path):
    c = cohort(spark, sf)
    SK.write_cohort(c, str(tmp_path / "cohort"))
    assert spark.read.parquet(str(tmp_path / "cohort")).count() == c.count()
    SK.write_site_tables(site_a(spark, sf), str(tmp_path / "sites"), "max")
    back = spark.read.parquet(str(tmp_path / "sites"))
    assert set(back.columns) >= {"site", "mode"}
    assert back.where("site = 'A' AND mode = 'max'").count() > 0


def test_fold_results_json(spark, sf, tmp_path):
    per = EV.per_fold_followup(spark, sf)
    SK.write_fold_results(per, str(tmp_path / "res"))
    files = list((tmp_path / "res").rglob("*.json"))
    rec = json.loads(next(l for f in files for l in f.read_text().splitlines() if l))
    assert rec["result"]["Confusion Matrix"]["labels"] == ["Negativo", "Positivo"]
    assert " - " in rec["result"]["Confusion Matrix"]["matrix"][0]


def test_previous_best_missing_is_empty(spark, tmp_path):
    df = SK.read_previous_best(spark, str(tmp_path / "nope"))
    assert df.count() == 0


def test_metric_log_append(spark, sf, tmp_path):
    import __spark_entry__ as E
    log = E.queries()["metric_log"](spark, sf)
    SK.append_metric_log(log, str(tmp_path / "log"))
    SK.append_metric_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 * log.count()


def test_read_visits_by_extension(spark, sf, tmp_path):
    import pytest
    from cohortkit.sources import fixtures as fx
    from cohortkit.sources.tables import read_visits
    from cohortkit.operators import harmonise as H
    raw = fx.fx_site_b(spark, sf)
    raw.write.option("header", True).csv(str(tmp_path / "b.csv"))
    back = read_visits(spark, str(tmp_path / "b.csv"))
    assert back.count() == raw.count()
    # text columns from CSV go through the same cleaning (try_cast handles numbers as text)
    assert H.clean_site_b(back.withColumn("row_id", back.row_id.cast("long"))).count() == raw.count()
    with pytest.raises(ValueError):
        read_visits(spark, str(tmp_path / "b.xlsx"))


def test_summary_json(spark, sf, tmp_path):
    from cohortkit.operators import metrics as MT
    s = MT.fold_summary(EV.per_fold_followup(spark, sf), ["accuracy", "f1"], ["years"])
    SK.write_summary(s, str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).count() == 3


def test_cohort_csv_and_sample_export(spark, sf, tmp_path):
    from pyspark.sql import functions as F
    from cohortkit.operators import features as FT
    from cohortkit.plans.features import features
    from cohortkit.sources.tables import read_cohort_csv
    f = features(spark, sf)
    f.write.option("header", True).csv(str(tmp_path / "cohort.csv"))
    back = read_cohort_csv(spark, str(tmp_path / "cohort.csv"))
    assert back.count() == f.count() and set(back.columns) == set(f.columns)
    scored = (f.select("Code", *FT.FEATURES, *[F.col(c).alias(f"o_{c}") for c in FT.FEATURES])
               .withColumn("prob", F.lit(0.7)).withColumn("prediction", (F.col("Code") % 2).cast("int"))
               .withColumn("fold", F.lit(8)))
    SK.export_samples(SK.sample_records(scored, FT.FEATURES), str(tmp_path / "samples"), folds=[8])
    parts = sorted(p.name for p in (tmp_path / "samples" / "fold=8").iterdir() if p.is_dir())
    assert parts == ["prediction=0", "prediction=1"]
    rec = json.loads(next(l for p in (tmp_path / "samples").rglob("*.json") for l in p.read_text().splitlines() if l))
    assert set(json.loads(rec["record"])) == {"features_scaled", "features_original", "probability", "prediction"}


def test_previous_best_broken_record_is_counted(spark, tmp_path):
    d = tmp_path / "best"
    d.mkdir()
    (d / "part-0.json").write_text('{not json at all\n{"fold": 2, "run_id": "a", "config": {"lr": "1"}, "metrics": {"f1": 0.5}}\n')
    stored = SK.read_previous_best(spark, str(d)).cache()
    assert stored.where("_corrupt IS NOT NULL").count() == 1
    cur = spark.createDataFrame([(1, "b", {"lr": "2"}, {"f1": 0.4}), (2, "b", {"lr": "2"}, {"f1": float("nan")})], SK.BEST_SCHEMA)
    out = {r.fold: r for r in SK.write_improved(cur, stored, "f1", str(tmp_path / "next")).collect()}
    assert out[1].config == {"lr": "2"} and out[2].run_id == "a" and out[2].metrics == {"f1": 0.5}


def test_previous_best_failure_is_not_no_data(spark, tmp_path):
    import pytest
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-0.json.gz").write_bytes(b"not gzip")
    with pytest.raises(Exception):
        SK.read_previous_best(spark, str(tmp_path / "x")).collect()


def test_metric_log_folders_are_bounded(spark, tmp_path):
    log = spark.range(1000).selectExpr("id AS run_id", "1L AS epoch", "'f1' AS metric", "0.5D AS value")
    SK.append_metric_log(log, str(tmp_path / "log"))
    assert len([p for p in (tmp_path / "log").iterdir() if p.is_dir()]) <= SK.LOG_BUCKETS
    assert [r.run_id for r in SK.read_metric_log(spark, str(tmp_path / "log"), 77).collect()] == [77]


def test_session_sets_no_master(monkeypatch):
    import inspect

    from cohortkit import session
    sig = inspect.signature(session.build_session).parameters
    assert sig["master"].default is None and sig["shuffle_partitions"].default is None
    assert "spark.sql.shuffle.partitions" not in session.DEFAULT_CONF
