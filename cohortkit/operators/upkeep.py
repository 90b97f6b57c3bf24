"""One row per patient kept up to date while sheets arrive.

The state is a table bucketed and sorted by patient.  An arrival is reduced to
its own winners (partial aggregation before its one shuffle) and written as a
further run into the same buckets, so an append costs what arrived and never
reads the state.  All rows of a patient lie in one bucket: the current cohort
is an aggregate without an exchange, and an arrival is compared with the
stored rows by a join that shuffles the arrival only.  A patient has at most
one row per run, so no patient makes a bucket hot; :func:`compact` brings the
runs back to one, again without an exchange.

The winner of winners is the winner of all visits, in any order of arrival,
and an arrival written twice changes nothing; a killed append is repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortkit.operators.harmonise import one_row_per_entity
from cohortkit.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class State:
    """Where the state lies and which row of a patient wins.

    ``buckets`` is fixed when the state is made: size it to the patients
    expected (a bucket is one task's work).
    """
    table: str
    path: str
    schema: StructType
    key: str = "Code"
    by: str = "dateAssess"
    rule: str = "last"
    ties: str = "first"
    tiebreak: tuple[str, ...] = ("site_order", "row_id")
    buckets: int = 32


def create(visits: DataFrame, path: str | None = None, **rules) -> State:
    """An empty state for rows like ``visits``, below the shared folder unless ``path`` names a place."""
    spark = visits.sparkSession
    table = f"cohort_state_{uuid.uuid4().hex}"
    state = State(table, path or f"{ensure_checkpoint_dir(spark)}/{table}", visits.schema, **rules)
    return attach(spark, state)


def attach(spark: SparkSession, state: State) -> State:
    """Name the state's folder in this session's catalog: at creation, and again in a session started later."""
    quoted = state.path.replace("'", "\\'")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {state.table} ({columns}) USING parquet "
              f"CLUSTERED BY (`{state.key}`) SORTED BY (`{state.key}`) INTO {state.buckets} BUCKETS LOCATION '{quoted}'")
    return state


def _arrived(visits: DataFrame, s: State) -> DataFrame:
    """The arrival's winners, dealt into the state's buckets: beside them, the stored side stays where it is."""
    return _winners(visits, s).repartition(s.buckets, s.key)


def _winners(df: DataFrame, s: State) -> DataFrame:
    columns = [c for c in s.schema.names if c != s.key]
    won = one_row_per_entity(df, s.key, s.by, s.rule, s.ties, s.tiebreak, columns)
    return won.select(*s.schema.names)


def _write(rows: DataFrame, s: State) -> None:
    (rows.write.mode("append").format("parquet").bucketBy(s.buckets, s.key).sortBy(s.key)
     .option("path", s.path).saveAsTable(s.table))


def append(state: State, visits: DataFrame) -> None:
    """Add newly arrived visits.  Rows without a patient or a visit day never win and are not stored."""
    _write(_arrived(visits, state), state)


def current(spark: SparkSession, state: State) -> DataFrame:
    """One row per patient as of all arrivals so far; no exchange."""
    return _winners(spark.table(state.table), state)


def changes(spark: SparkSession, state: State, visits: DataFrame) -> DataFrame:
    """What the arrival ``visits`` would alter: the new rows, with ``change`` 'new' or 'replaced'.

    Only the arrival is shuffled.  An arrival whose row equals the stored one
    alters nothing.  Call it before :func:`append`.
    """
    names = state.schema.names
    came = _arrived(visits, state).select(F.col(state.key), F.struct(*names).alias("_new"))
    held = current(spark, state).select(F.col(state.key).alias("_key"), F.struct(*names).alias("_old"))
    met = came.join(held, F.col(state.key) == F.col("_key"), "left")
    # The winner of the two by the state's own rule, so that ties end as in the state.
    both = met.select(F.col("_old").isNull().alias("_first"), "_old", F.inline(F.array("_new", F.coalesce("_old", "_new"))))
    extra = [c for c in names if c != state.key] + ["_first", "_old"]
    won = one_row_per_entity(both, state.key, state.by, state.rule, state.ties, state.tiebreak, extra)
    altered = won.where(F.col("_first") | ~F.struct(*names).eqNullSafe(F.col("_old")))
    return altered.select(*names, F.when(F.col("_first"), "new").otherwise("replaced").alias("change"))


def compact(spark: SparkSession, state: State) -> State:
    """The same state as one run in a new folder; the old one stays until :func:`drop`."""
    table = f"cohort_state_{uuid.uuid4().hex}"
    out = attach(spark, replace(state, table=table, path=f"{state.path.rstrip('/')}-{table[-8:]}"))
    _write(current(spark, state), out)
    return out


def drop(spark: SparkSession, state: State) -> None:
    """Forget the table and delete its folder."""
    spark.sql(f"DROP TABLE IF EXISTS {state.table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(state.path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
