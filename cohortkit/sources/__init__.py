"""Sources and sinks."""

from cohortkit.sources.tables import load_table, require_columns, read_visits, read_cohort_csv  # noqa: F401
