"""Column functions for recodes and coercions.

All of them return ``Column`` expressions made of built-in functions, so they
stay inside whole-stage codegen.  The missing-value rules follow SURVEY 1.4:
non-numeric text becomes NULL (``try_cast``), NaN becomes NULL before any
comparison (Spark orders NaN above every number), unknown codes in a map
become NULL, and a missing pressure never makes hypertension true.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

# The code tables of the two site sheets.
GENDER_CODES = {1: "M", 2: "F", "M": "M", "F": "F"}
YES_NO_SITE_A = {"Y": 1, "N": 0, 1: 1, 0: 0}
YES_NO_SITE_B = {"Y": 1, "Yes": 1, 1: 1, "N": 0, "No": 0, 0: 0}
LABEL_CODES = {1: 1, "1": 1, 0: 0, "0": 0}
# Sex to number, four encodings found in the scripts.
SEX_ENCODINGS = {
    "M0F1": ({"M": 0, "F": 1}, True),                     # replace: unmatched kept
    "M1F2": ({"M": 1, "F": 2}, True),                     # replace: unmatched kept
    "M1F0": ({"M": 1, "F": 0}, False),                    # map: unmatched -> NULL
    "M0F1_any_case": ({"M": 0, "F": 1, "m": 0, "f": 1}, True),
}
# Clinical cut-offs for hypertension (mm Hg) and the treated code.
SYSTOLIC_CUTOFF = 140
DIASTOLIC_CUTOFF = 90
TREATED_CODE = "Y"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit_sql(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _to_double_sql(name: str) -> str:
    return f"nanvl(try_cast({_q(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL for a double column (keeps NULL semantics in comparisons)."""
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def to_double(c: str | Column) -> Column:
    """Lenient numeric coercion (P6): junk text, blanks and NaN become NULL."""
    if isinstance(c, str):
        return F.expr(_to_double_sql(c))
    return nan_to_null(c.try_cast("double"))


def recode(df: DataFrame, name: str, mapping: Mapping, keep_unmatched: bool = False,
           out_type: str | None = None) -> Column:
    """Map codes to values (``map`` semantics: unmatched -> NULL).

    Keys are matched by the column's type: a numeric column matches numeric
    keys, a text column matches the text form of every key (a sheet exported
    to CSV stores the code 1 as the text "1").  ``keep_unmatched`` gives
    ``replace`` semantics: values without a key pass through (cast to the
    output type when possible, else NULL).  Built as one SQL ``CASE``.
    """
    numeric = isinstance(df.schema[name].dataType, NumericType)
    if out_type is None:
        out_type = "string" if all(isinstance(v, str) for v in mapping.values()) else "int"
    col = _q(name)
    arms = [f"WHEN {col} = {_lit_sql(k if numeric else str(k))} THEN {_lit_sql(v)}"
            for k, v in mapping.items() if not (numeric and isinstance(k, str))]
    if keep_unmatched:
        rest = f"CAST({col} AS {out_type})" if numeric or out_type == "string" else f"try_cast({col} AS {out_type})"
    else:
        rest = "NULL"
    if not arms:
        return F.expr(f"CAST({rest} AS {out_type})")
    return F.expr(f"CAST(CASE {' '.join(arms)} ELSE {rest} END AS {out_type})")


def gender(df: DataFrame, name: str) -> Column:
    """{1: M, 2: F, M: M, F: F}, anything else NULL."""
    return recode(df, name, GENDER_CODES, out_type="string")


def sex_to_number(df: DataFrame, name: str, encoding: str = "M0F1") -> Column:
    """P5: sex as a number; see ``SEX_ENCODINGS`` for the four variants."""
    mapping, keep = SEX_ENCODINGS[encoding]
    if isinstance(df.schema[name].dataType, NumericType):
        return F.col(name).cast("double")
    return recode(df, name, mapping, keep_unmatched=keep, out_type="double")


def hypertension(systolic: str, diastolic: str, treated_raw: str | None = None, coerce: bool = True) -> Column:
    """SBP >= 140 or DBP >= 90 or treated == 'Y' -> 1, else 0 (never NULL).

    ``treated_raw`` is the raw treatment code: only the text 'Y' counts.
    With ``coerce`` the pressures are coerced leniently first (P6).
    """
    sy = _to_double_sql(systolic) if coerce else f"nanvl({_q(systolic)}, CAST(NULL AS DOUBLE))"
    di = _to_double_sql(diastolic) if coerce else f"nanvl({_q(diastolic)}, CAST(NULL AS DOUBLE))"
    cond = (f"coalesce({sy} >= {SYSTOLIC_CUTOFF}, false) OR coalesce({di} >= {DIASTOLIC_CUTOFF}, false)")
    if treated_raw is not None:
        cond += f" OR coalesce(CAST({_q(treated_raw)} AS STRING) = {_lit_sql(TREATED_CODE)}, false)"
    return F.expr(f"CAST(({cond}) AS INT)")


def yes_no(df: DataFrame, name: str, site: str = "A") -> Column:
    """yes/no codes -> nullable 0/1."""
    return recode(df, name, YES_NO_SITE_A if site == "A" else YES_NO_SITE_B, out_type="int")


def any_flag_strict(*cols: str | Column) -> Column:
    """Bitwise OR of nullable 0/1 flags; any NULL makes the result NULL
    (no three-valued shortcut, unlike boolean OR)."""
    return reduce(lambda a, b: a.bitwiseOR(b), [_col(c) for c in cols])


def positive_flag(c: str) -> Column:
    """Number > 0 -> 1; missing or junk -> 0."""
    return F.expr(f"CAST(coalesce({_to_double_sql(c)} > 0, false) AS INT)")


def label(df: DataFrame, name: str) -> Column:
    """{1, '1'} -> 1, {0, '0'} -> 0, else NULL."""
    return recode(df, name, LABEL_CODES, out_type="int")


def round_half_even(c: str | Column) -> Column:
    """Age rounding the way the reference does it (banker's rounding)."""
    return F.bround(_col(c), 0).cast("int")


def any_therapy_max(*cols: str | Column) -> Column:
    """Row max of therapy flags; NULLs skipped, all NULL -> NULL."""
    return F.greatest(*[nan_to_null(_col(c).cast("double")) for c in cols])


def any_therapy_sum(df: DataFrame, candidates: list[str]) -> Column:
    """1 when the sum of the present therapy columns (NULL as 0) is > 0."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        raise ValueError(f"no therapy column present; looked for {candidates}")
    total = reduce(lambda a, b: a + b, [F.coalesce(to_double(c), F.lit(0.0)) for c in present])
    return (total > 0).cast("int")


def fill_invalid(c: str | Column, value: float = 0.0) -> Column:
    """NULL, NaN, +Inf, -Inf -> ``value`` (numpy ``nan_to_num``)."""
    x = _col(c).cast("double")
    bad = x.isNull() | F.isnan(x) | (x == float("inf")) | (x == float("-inf"))
    return F.when(bad, F.lit(value)).otherwise(x)
