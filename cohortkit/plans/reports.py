"""Result records."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit.operators import features as FT
from cohortkit.operators import splits as SP
from cohortkit.operators import training as TR
from cohortkit.plans import evaluation as EV
from cohortkit.plans.features import stored_split_features as split_features
from cohortkit.plans.oracle import with_ctes
from cohortkit.plans.registry import query
from cohortkit.sources import sinks as SK

EXPORT_FOLD = 8  # the reference exports the samples of one fold


@query("fold_results", with_ctes("""
SELECT fold, years, concat(CAST(tn AS VARCHAR), ' - ', CAST(fp AS VARCHAR)) AS cm_row0,
       concat(CAST(fn AS VARCHAR), ' - ', CAST(tp AS VARCHAR)) AS cm_row1,
       accuracy, precision, recall, f1, auc
FROM per_fold_followup""", "per_fold_followup"), "S7,M1 (confusion as 'tn - fp' text rows)")
def q_fold_results(spark, sf):
    x = SK.confusion_text(EV.per_fold_followup(spark, sf))
    return x.select("fold", "years", "cm_row0", "cm_row1", "accuracy", "precision", "recall", "f1", "auc")


@query("sample_export", None, "S12,P28,T6")
def q_sample_export(spark, sf):
    """Fold model (scaler + weighted logistic) fitted on the fold's training
    part scores the test rows; one JSON record per row, keyed by fold and
    predicted class."""
    s = split_features(spark, sf)
    train = TR.with_pos_weight(SP.train_rows(s, EXPORT_FOLD), "label")
    model = TR.classifier_pipeline(TR.weighted_logistic()).fit(train)
    test = SP.test_rows(s).select("Code", "label", *FT.FEATURES,
                                  *[F.col(f).alias(f"o_{f}") for f in FT.FEATURES])
    scored = TR.probability_of_one(model.transform(test)).withColumn("fold", F.lit(EXPORT_FOLD))
    return SK.sample_records(scored, FT.FEATURES)
