"""Sinks (S5-S12) and the per-sample feature records.

Everything is written by executors in parallel (``DataFrameWriter``), with
partition columns where readers filter (site, mode, fold, run).  Nothing is
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StringType, StructField, StructType

from cohortkit.functions.recode import nan_to_null
from cohortkit.sources.tables import path_exists

# Labels of the confusion-matrix record.
CONFUSION_LABELS = ["Negativo", "Positivo"]


def write_site_tables(site: DataFrame, path: str, mode: str) -> None:
    """Cleaned per-site visits, partitioned by site and mode
    ('min' = baseline, 'max' = last)."""
    site.withColumn("mode", F.lit(mode)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("site", "mode").parquet(path)


def write_cohort(cohort: DataFrame, path: str, sort: Sequence[str] = ()) -> None:
    """One row per patient; ``sort`` orders the file's rows by key."""
    (cohort.orderBy(*sort) if sort else cohort).write.mode("overwrite").parquet(path)


def confusion_text(df: DataFrame) -> DataFrame:
    """Matrix rows as the reference prints them: 'tn - fp', 'fn - tp'."""
    return df.withColumn("cm_row0", F.concat_ws(" - ", F.col("tn").cast("string"), F.col("fp").cast("string"))) \
             .withColumn("cm_row1", F.concat_ws(" - ", F.col("fn").cast("string"), F.col("tp").cast("string")))


def fold_result_records(per_fold: DataFrame) -> DataFrame:
    """S7 record per (fold, threshold): nested struct with the confusion
    matrix as text rows."""
    x = confusion_text(per_fold)
    return x.select(
        "fold",
        F.struct(F.col("years").alias("Years Threshold"), F.col("accuracy").alias("Accuracy"),
                 F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
                 F.col("f1").alias("F1 Score"),
                 F.struct(F.array(*[F.lit(s) for s in CONFUSION_LABELS]).alias("labels"),
                          F.array("cm_row0", "cm_row1").alias("matrix")).alias("Confusion Matrix"),
                 F.col("auc").alias("AUC")).alias("result"))


def write_fold_results(per_fold: DataFrame, path: str) -> None:
    """Per-fold results as JSON lines, one folder per fold."""
    fold_result_records(per_fold).write.mode("overwrite").partitionBy("fold").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Fold summary (mean ± std text) as JSON."""
    summary.write.mode("overwrite").json(path)


LOG_BUCKETS = 64  # folders of the metric log, whatever the number of runs


def append_metric_log(log_long: DataFrame, path: str) -> None:
    """Epoch metric log, appended, in hash buckets of the run."""
    log_long.withColumn("bucket", F.pmod(F.hash("run_id"), F.lit(LOG_BUCKETS))).write.mode("append").partitionBy("bucket").parquet(path)


def read_metric_log(spark: SparkSession, path: str, run_id: int | None = None) -> DataFrame:
    """The metric log, or one run of it (one folder is read)."""
    log = spark.read.parquet(path)
    if run_id is not None:
        log = log.where((F.col("bucket") == F.pmod(F.hash(F.lit(run_id).cast("long")), F.lit(LOG_BUCKETS))) & (F.col("run_id") == run_id))
    return log.drop("bucket")


# Best model of a fold: where it came from, its parameters and its metrics.
BEST_SCHEMA = StructType([
    StructField("fold", LongType()), StructField("run_id", StringType()),
    StructField("config", MapType(StringType(), StringType())),
    StructField("metrics", MapType(StringType(), DoubleType()))])
BAD_RECORD = "_corrupt"


def best_records(best: DataFrame, params: Sequence[str], metrics: Sequence[str], fold: str = "fold", run: str = "run_id") -> DataFrame:
    """One nested record per fold: configuration and best metrics."""
    def pairs(cols: Sequence[str], kind: str) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast(kind) for c in cols]))

    return best.select(F.col(fold).cast("long").alias("fold"), F.col(run).cast("string").alias("run_id"),
                       pairs(params, "string").alias("config"), pairs(metrics, "double").alias("metrics"))


def read_previous_best(spark: SparkSession, path: str, schema: StructType = BEST_SCHEMA) -> DataFrame:
    """Stored bests; without a stored file an empty table (the caller's
    left join then defaults to 0.0).

    Malformed records are kept as rows with only ``_corrupt`` set, so that they
    can be counted; any other failure to read is an error.
    """
    full = StructType([*schema.fields, StructField(BAD_RECORD, StringType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("columnNameOfCorruptRecord", BAD_RECORD).json(path)


def write_improved(current: DataFrame, stored: DataFrame, metric: str, path: str) -> DataFrame:
    """Writes, per fold, the current record where its metric beats the stored one, else the stored one.

    ``path`` is a new folder: the table that is read is never overwritten.
    """
    s = stored.where(F.col("fold").isNotNull()).select(F.col("fold").alias("_f"), F.struct("run_id", "config", "metrics").alias("_old"))
    j = current.join(s, F.col("fold") == F.col("_f"), "full")
    value = nan_to_null(F.col("metrics")[metric])
    better = value > F.coalesce(nan_to_null(F.col("_old.metrics")[metric]), F.lit(0.0))
    keep = F.when(F.coalesce(better, F.lit(False)) | F.col("_old").isNull(), F.struct("run_id", "config", "metrics")).otherwise(F.col("_old"))
    j.select(F.coalesce("fold", "_f").alias("fold"), keep.alias("r")).select("fold", "r.*").write.json(path)
    return read_previous_best(current.sparkSession, path)


def sample_records(scored: DataFrame, features: Sequence[str], scaled_prefix: str = "",
                   original_prefix: str = "o_") -> DataFrame:
    """One record per scored row: scaled and original feature maps,
    probability and class."""
    names = F.array(*[F.lit(f) for f in features])
    scaled = F.map_from_arrays(names, F.array(*[F.col(f"{scaled_prefix}{f}").cast("double") for f in features]))
    orig = F.map_from_arrays(names, F.array(*[F.col(f"{original_prefix}{f}").cast("double") for f in features]))
    return scored.select("fold", "prediction", F.to_json(F.struct(
        scaled.alias("features_scaled"), orig.alias("features_original"),
        F.col("prob").cast("double").alias("probability"),
        F.col("prediction").cast("int").alias("prediction"))).alias("record"))


def export_samples(records: DataFrame, path: str, folds: Sequence[int] | None = None) -> None:
    """Positive / negative sample export, partitioned by fold and
    predicted class; ``folds`` selects which folds to keep (the reference
    keeps fold 8 only)."""
    x = records if folds is None else records.where(F.col("fold").isin(list(folds)))
    x.write.mode("overwrite").partitionBy("fold", "prediction").json(path)
