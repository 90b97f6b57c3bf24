"""Golden check: rates and fold summary recomputed from stored confusion
matrices of the reference (last-visit cohort, seed 42, threshold 0)."""
from cohortkit.operators import metrics as MT

# Stored confusion matrices (tn, fp, fn, tp) of folds 1-10 and
# the stored accuracy / precision / recall / F1 of each fold.
GOLDEN = [
    (1, 127, 19, 8, 35, 0.857143, 0.648148, 0.813953, 0.721649),
    (2, 135, 11, 12, 31, 0.878307, 0.738095, 0.720930, 0.729412),
    (3, 137, 9, 13, 30, 0.883598, 0.769231, 0.697674, 0.731707),
    (4, 134, 12, 10, 33, 0.883598, 0.733333, 0.767442, 0.750000),
    (5, 134, 12, 11, 32, 0.878307, 0.727273, 0.744186, 0.735632),
    (6, 136, 10, 10, 33, 0.894180, 0.767442, 0.767442, 0.767442),
    (7, 128, 18, 10, 33, 0.851852, 0.647059, 0.767442, 0.702128),
    (8, 137, 9, 10, 33, 0.899471, 0.785714, 0.767442, 0.776471),
    (9, 138, 8, 12, 31, 0.894180, 0.794872, 0.720930, 0.756098),
    (10, 139, 7, 12, 31, 0.899471, 0.815789, 0.720930, 0.765432),
]
# The stored fold summary text for the same folds.
GOLDEN_SUMMARY = {"accuracy": "0.8820 ± 0.0157", "precision": "0.7427 ± 0.0545",
                  "recall": "0.7488 ± 0.0326", "f1": "0.7436 ± 0.0222"}


def test_rates_match_stored(spark):
    cm = spark.createDataFrame([g[:5] for g in GOLDEN], "fold int, tn long, fp long, fn long, tp long")
    got = {r.fold: r for r in MT.rates(cm).collect()}
    for fold, *_, acc, prec, rec, f1 in GOLDEN:
        r = got[fold]
        assert abs(r.accuracy - acc) < 1e-6 and abs(r.precision - prec) < 1e-6
        assert abs(r.recall - rec) < 1e-6 and abs(r.f1 - f1) < 1e-6


def test_summary_text_matches_stored(spark):
    cm = spark.createDataFrame([(*g[:5], 0) for g in GOLDEN], "fold int, tn long, fp long, fn long, tp long, years int")
    s = MT.fold_summary(MT.rates(cm), ["accuracy", "precision", "recall", "f1"], ["years"]).first()
    for m, text in GOLDEN_SUMMARY.items():
        assert s[f"{m}_text"] == text
