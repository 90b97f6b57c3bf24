"""Table readers and the required-column check."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (``{sf_dir}/{name}.parquet``).

    Parquet keeps column pruning and filter pushdown down at the scan.
    """
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at ``path``, in whatever store Spark reads?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_columns(df: DataFrame, all_of: Iterable[str] = (), any_of: Iterable[str] = ()) -> list[str]:
    """Fail fast when columns are missing.

    ``all_of`` must all be present; of ``any_of`` at least one must be.
    Returns the present members of ``any_of`` (the reference keeps going with
    whichever therapy columns exist).  Only the schema is touched, no job runs.
    """
    cols = set(df.columns)
    missing = [c for c in all_of if c not in cols]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    any_of = list(any_of)
    present = [c for c in any_of if c in cols]
    if any_of and not present:
        raise ValueError(f"none of these columns found: {any_of}")
    return present


_READERS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def read_visits(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Site visit table, format chosen by file extension.

    Unknown extensions raise, as the reference does.  Spreadsheet formats are
    not read (see README, "Not built"): export them to CSV or Parquet.
    """
    ext = os.path.splitext(path.rstrip("/"))[-1].lower()
    fmt = _READERS.get(ext)
    if fmt is None:
        raise ValueError(f"unsupported format: {ext or path}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            # Raw site sheets mix numbers and text in one column; read as text
            # and coerce with try_cast later.
            reader = reader.option("inferSchema", False)
    return reader.format(fmt).load(path)


def read_cohort_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Merged cohort CSV of the second pipeline.

    Without ``schema`` all columns are text (one pass); numbers are coerced
    where they are used, like those of the site sheets.
    """
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)
