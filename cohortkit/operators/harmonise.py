"""Harmonise site sheets into one schema and keep one row per patient.

P1-P16 (projection, renames, recodes), W1 (forward fill), U1 (stack sites)
and W2-W5 (first / last visit per patient).  Each site function is a plain
``DataFrame -> DataFrame`` transformation; the cohort builders stack the
sites with ``unionByName`` and reduce with ``max_by`` / ``min_by`` on a
struct ordering key, which aggregates partially before the shuffle, so a
patient with very many visits costs one partial row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions import recode as R
from cohortkit.operators.ranking import carry_forward
from cohortkit.sources.tables import require_columns

# The common cohort schema, in output order.
COHORT_COLUMNS = [
    "Code", "Gender", "Age", "dateAssess", "Hypertension",
    "M", "E", "S", "T", "C", "Proteinuria", "Creatinine",
    "Antihypertensive", "Immunosuppressants", "FishOil", "Eskd",
]
SCORE_COLUMNS = ["M", "E", "S", "T", "C"]

# Which raw column feeds each measurement, by mode
# ('min' = baseline visit, 'max' = last visit).
SITE_A_MEASURES = {
    "min": {"creatinine": "creat_mgdl", "proteinuria": "uprot_gday",
            "diastolic": "DiastolicbloodpressuremmHg", "systolic": "SystolicbloodpressuremmHg"},
    "max": {"creatinine": "creat_mgdl_last", "proteinuria": "uprot_gday_last",
            "diastolic": "DBPlast", "systolic": "SBPlast"},
}
SITE_A_COMMON = ["VALIGA_CODE", "RBdate", "Lastvisit", "Gender1M2F", "age",
                 "M", "E", "S", "T", "C", "AceiYN", "Fishoil", "CELLCEPT", "AZA", "CsIm", "ESKDcorretto"]
SITE_B_COLUMNS = ["VALIGA_CODE", "SEX", "M", "E", "S", "T", "C", "dateAssess", "systolic", "Diastolic",
                  "age", "creat_mg_dl", "outcome", "Uprot", "nb_of_bpmeds", "ras_blockers",
                  "fish_oil", "Immunotherapies"]
# Headers of the site B sheet as delivered, and the names used here.
SITE_B_HEADERS = {"VALIGA CODE": "VALIGA_CODE", "Nb of Bpmeds": "nb_of_bpmeds", "RAS blockers": "ras_blockers",
                  "fish oil": "fish_oil"}
DATE_FORMAT = "dd/MM/yyyy"


def _day(c: str, lenient: bool) -> Column:
    if lenient:
        return F.to_date(F.try_to_timestamp(F.col(c), F.lit(DATE_FORMAT)))
    return F.to_date(F.col(c), DATE_FORMAT)


def clean_site_a(raw: DataFrame, mode: str = "max", ffill_scope: str = "table",
                 lenient_dates: bool = False, row_id: str = "row_id") -> DataFrame:
    """Site A sheet -> common schema (one row per visit).

    Hypertension counts the raw treatment code 'Y' only (it is evaluated
    before the yes/no recode, so the code 1 does not count).  Proteinuria is
    forward filled in sheet order: across the whole sheet (``'table'``, the
    reference behaviour) or within a patient (``'entity'``).
    """
    m = SITE_A_MEASURES[mode]
    require_columns(raw, SITE_A_COMMON + list(m.values()) + [row_id])
    x = raw.select(
        F.col("VALIGA_CODE"), F.col(row_id).alias("row_id"),
        R.gender(raw, "Gender1M2F").alias("Gender"),
        F.col("age").cast("double").alias("Age"),
        F.datediff(_day("Lastvisit", lenient_dates), _day("RBdate", lenient_dates)).alias("dateAssess"),
        R.hypertension(m["systolic"], m["diastolic"], "AceiYN").alias("Hypertension"),
        *[F.col(c) for c in SCORE_COLUMNS],
        R.to_double(m["proteinuria"]).alias("Proteinuria"),
        R.to_double(m["creatinine"]).alias("Creatinine"),
        R.yes_no(raw, "AceiYN", "A").alias("Antihypertensive"),
        R.any_flag_strict(R.yes_no(raw, "CsIm", "A"), R.yes_no(raw, "AZA", "A"),
                          R.yes_no(raw, "CELLCEPT", "A")).alias("Immunosuppressants"),
        R.yes_no(raw, "Fishoil", "A").alias("FishOil"),
        R.label(raw, "ESKDcorretto").alias("Eskd"),
    )
    return _ffill(x, ffill_scope).withColumn("site", F.lit("A"))


def clean_site_b(raw: DataFrame, ffill_scope: str = "table", row_id: str = "row_id") -> DataFrame:
    """Site B sheet -> common schema (one row per visit); takes the sheet's own headers too."""
    raw = raw.withColumnsRenamed({k: v for k, v in SITE_B_HEADERS.items() if k in raw.columns})
    require_columns(raw, SITE_B_COLUMNS + [row_id])
    x = raw.select(
        F.col("VALIGA_CODE"), F.col(row_id).alias("row_id"),
        R.gender(raw, "SEX").alias("Gender"),
        F.col("age").cast("double").alias("Age"),
        F.col("dateAssess").cast("int").alias("dateAssess"),
        R.hypertension("systolic", "Diastolic").alias("Hypertension"),
        *[F.col(c) for c in SCORE_COLUMNS],
        R.to_double("Uprot").alias("Proteinuria"),
        R.to_double("creat_mg_dl").alias("Creatinine"),
        R.positive_flag("nb_of_bpmeds").alias("Antihypertensive"),
        R.yes_no(raw, "Immunotherapies", "B").alias("Immunosuppressants"),
        R.yes_no(raw, "fish_oil", "B").alias("FishOil"),
        R.label(raw, "outcome").alias("Eskd"),
    )
    return _ffill(x, ffill_scope).withColumn("site", F.lit("B"))


def _ffill(x: DataFrame, scope: str) -> DataFrame:
    if scope == "none":
        return x
    by = ["VALIGA_CODE"] if scope == "entity" else []
    return carry_forward(x, "Proteinuria", "row_id", by=by)


SITE_COLUMNS = ["VALIGA_CODE", "row_id", "Gender", "Age", "dateAssess", "Hypertension",
                *SCORE_COLUMNS, "Proteinuria", "Creatinine",
                "Antihypertensive", "Immunosuppressants", "FishOil", "Eskd", "site"]


def _as_cohort_rows(site: DataFrame, round_age: bool) -> DataFrame:
    x = site.select(*SITE_COLUMNS).withColumnRenamed("VALIGA_CODE", "Code")
    if round_age:
        x = x.withColumn("Age", R.round_half_even("Age"))
    return x.withColumn("site_order", F.when(F.col("site") == "A", 0).otherwise(1))


def stack_sites(a: DataFrame, b: DataFrame, round_age: bool = True) -> DataFrame:
    """Stack the two cleaned sheets; site A rows come first in sheet order."""
    return _as_cohort_rows(a, round_age).unionByName(_as_cohort_rows(b, round_age))


def one_row_per_entity(df: DataFrame, key: str = "Code", by: str = "dateAssess",
                       rule: str = "last", ties: str = "first",
                       tiebreak: tuple[str, ...] = ("site_order", "row_id"),
                       columns: list[str] | None = None) -> DataFrame:
    """Keep one row per ``key``.

    ``rule='last'`` keeps the largest ``by`` (latest visit), ``'first'`` the
    smallest.  ``ties='first'`` keeps the earliest row in sheet order (pandas
    ``idxmax``/``idxmin``), ``'last'`` the latest (``sort_values().tail(1)``).
    Rows with NULL ``key`` or NULL ``by`` never win, rows with a NULL
    tie-break column lose ties.  One grouped
    ``max_by``/``min_by`` on a struct ordering key: partial aggregation runs
    before the shuffle.
    """
    columns = columns or [c for c in df.columns if c != key]
    q = lambda c: "`" + c + "`"
    flip = (rule == "last") == (ties == "first")  # tie-break columns descending?
    pick = "max_by" if rule == "last" else "min_by"
    parts = [q(by)]
    for c in tiebreak:
        # NULL is the least value: under min_by a row without the tie-break column would win
        parts += [f"isnull({q(c)})"] if pick == "min_by" else []
        parts += [f"-{q(c)}" if flip else q(c)]
    order = ", ".join(parts)
    payload = ", ".join(q(c) for c in columns)
    expr = f"{pick}(struct({payload}), CASE WHEN {q(by)} IS NOT NULL THEN struct({order}) END)"
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.expr(expr).alias("_r"))
    return g.where(F.col("_r").isNotNull()).select(key, "_r.*")


def build_cohort(site_a: DataFrame, site_b: DataFrame, mode: str = "max") -> DataFrame:
    """Cohort, one row per patient (3.1), from cleaned site tables.

    ``mode='max'``: stack both sites, round ages, keep each patient's last
    visit (a code in both sites yields one row).  ``mode='min'``: site A keeps
    the first visit, site B the last, ages unrounded, then stack (W4: a code
    in both sites yields two rows).
    """
    if mode == "max":
        x = stack_sites(site_a, site_b, round_age=True)
        return one_row_per_entity(x, rule="last", columns=COHORT_COLUMNS[1:]).select(*COHORT_COLUMNS)
    fa = one_row_per_entity(_as_cohort_rows(site_a, False), rule="first", columns=COHORT_COLUMNS[1:])
    fb = one_row_per_entity(_as_cohort_rows(site_b, False), rule="last", columns=COHORT_COLUMNS[1:])
    return fa.select(*COHORT_COLUMNS).unionByName(fb.select(*COHORT_COLUMNS))
