"""DuckDB reference SQL for every registered query.

Independent, plain-SQL formulations (global windows, simple aggregates) of
what the Spark plans compute in a distributed way.  Each entry is a full
statement over the driver's views (orders, customer, events, ...).  Floating
results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

# --- stand-in inputs ------------------------------------------------------

CTE = {}

CTE["fx_site_a"] = """
SELECT CASE WHEN o.o_orderkey % 211 <> 5 THEN o.o_custkey END AS VALIGA_CODE,
       CASE WHEN o.o_orderkey % 223 <> 7 THEN o.o_orderkey END AS row_id,
       c.c_nationkey % 2 + 1 AS Gender1M2F,
       20 + o.o_custkey % 50 + CAST(o.o_custkey % 4 AS DOUBLE) / 4 AS age,
       strftime(o.rb, '%d/%m/%Y') AS RBdate,
       strftime(o.o_orderdate, '%d/%m/%Y') AS Lastvisit,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'n/a' WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderkey % 97 AS VARCHAR) END AS uprot_gday,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST((o.o_orderkey + 5) % 89 AS VARCHAR) END AS uprot_gday_last,
       CASE WHEN o.o_orderkey % 17 = 0 THEN '?' ELSE CAST(1 + o.o_orderkey % 8 AS VARCHAR) END AS creat_mgdl,
       CAST(1 + (o.o_orderkey + 3) % 9 AS VARCHAR) AS creat_mgdl_last,
       CASE WHEN o.o_orderkey % 19 = 0 THEN '' ELSE CAST(100 + o.o_orderkey % 70 AS VARCHAR) END AS SystolicbloodpressuremmHg,
       CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE CAST(60 + o.o_orderkey % 45 AS VARCHAR) END AS DiastolicbloodpressuremmHg,
       CAST(105 + o.o_orderkey % 70 AS VARCHAR) AS SBPlast, CAST(62 + o.o_orderkey % 45 AS VARCHAR) AS DBPlast,
       o.o_custkey % 2 AS M, o.o_custkey % 3 % 2 AS E, o.o_custkey % 5 % 2 AS S, o.o_custkey % 3 AS T, o.o_custkey % 7 % 3 AS C,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN '1' ELSE NULL END AS AceiYN,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE NULL END AS Fishoil,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'Y' ELSE 'N' END AS CsIm,
       CASE WHEN o.o_orderkey % 6 = 0 THEN 'Y' WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE 'N' END AS AZA,
       CASE WHEN o.o_orderkey % 8 = 0 THEN '1' ELSE '0' END AS CELLCEPT,
       CASE WHEN o.o_custkey % 4 = 0 THEN '1' WHEN o.o_custkey % 37 = 1 THEN NULL ELSE '0' END AS ESKDcorretto
FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS rb FROM orders) o
JOIN customer c ON c.c_custkey = o.o_custkey"""

CTE["fx_site_b"] = """
SELECT 100 + user_id AS VALIGA_CODE, event_id AS row_id,
       CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS SEX,
       user_id % 2 AS M, user_id % 3 % 2 AS E, user_id % 5 % 2 AS S, user_id % 3 AS T, user_id % 7 % 3 AS C,
       (user_id % 15) * 365 + day(ts) - 1 AS dateAssess,
       CASE WHEN event_id % 21 = 0 THEN 'n/a' ELSE CAST(100 + event_id % 70 AS VARCHAR) END AS systolic,
       CAST(60 + event_id % 45 AS VARCHAR) AS Diastolic,
       18 + user_id % 60 + CAST(user_id % 2 AS DOUBLE) / 2 AS age,
       CAST(1 + event_id % 7 AS VARCHAR) AS creat_mg_dl,
       CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS outcome,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 83 AS VARCHAR) END AS Uprot,
       CASE WHEN event_id % 10 = 0 THEN '-' ELSE CAST(event_id % 4 AS VARCHAR) END AS nb_of_bpmeds,
       CAST(event_id % 2 AS VARCHAR) AS ras_blockers,
       CASE event_id % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' WHEN 3 THEN '0' ELSE NULL END AS fish_oil,
       CASE event_id % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN '1' WHEN 2 THEN 'maybe' ELSE 'N' END AS Immunotherapies
FROM events"""

CTE["fx_scores"] = """
SELECT row_id AS id, y, CAST(20 + 30 * y + h % 50 AS DOUBLE) / 100 AS prob, fu_days
FROM (SELECT event_id AS row_id, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y,
             (event_id * 7919) % 101 AS h,
             CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN -5
                  ELSE (user_id % 15) * 365 + day(ts) - 1 END AS fu_days
      FROM events) e"""

CTE["fx_history"] = """
SELECT run_id, epoch,
       CASE WHEN k % 97 = 3 THEN CAST('nan' AS DOUBLE) WHEN k % 101 = 4 THEN NULL
            ELSE CAST(40 - least(epoch, 20 + run_id % 25) + (epoch * (7 + run_id % 25)) % 5 AS DOUBLE) / 40 END AS val_loss,
       CASE WHEN k % 89 = 2 THEN CAST('nan' AS DOUBLE) WHEN k % 103 = 6 THEN NULL
            ELSE CAST(50 + least(epoch, 15 + run_id % 25) + (epoch * (3 + run_id % 25)) % 7 AS DOUBLE) / 100 END AS val_f1
FROM (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 60) AS BIGINT) AS run_id,
             CAST(o_orderkey % 60 + 1 AS BIGINT) AS epoch FROM orders) o
WHERE NOT (run_id % 37 = 11 AND epoch > 1)"""


def _site_a_clean(mode: str, scope: str = "table") -> str:
    cr, pr, di, sy = (("creat_mgdl", "uprot_gday", "DiastolicbloodpressuremmHg", "SystolicbloodpressuremmHg")
                      if mode == "min" else ("creat_mgdl_last", "uprot_gday_last", "DBPlast", "SBPlast"))
    part = "PARTITION BY VALIGA_CODE " if scope == "entity" else ""
    yn = lambda c: f"CASE {c} WHEN 'Y' THEN 1 WHEN 'N' THEN 0 WHEN '1' THEN 1 WHEN '0' THEN 0 END"
    return f"""
SELECT VALIGA_CODE, row_id,
       CASE Gender1M2F WHEN 1 THEN 'M' WHEN 2 THEN 'F' END AS Gender,
       CAST(age AS DOUBLE) AS Age,
       CAST(datediff('day', strptime(RBdate, '%d/%m/%Y'), strptime(Lastvisit, '%d/%m/%Y')) AS INTEGER) AS dateAssess,
       CAST(coalesce(TRY_CAST({sy} AS DOUBLE) >= 140, false) OR coalesce(TRY_CAST({di} AS DOUBLE) >= 90, false)
            OR coalesce(AceiYN = 'Y', false) AS INTEGER) AS Hypertension,
       M, E, S, T, C,
       CASE WHEN row_id IS NULL THEN TRY_CAST({pr} AS DOUBLE) ELSE
       last_value(TRY_CAST({pr} AS DOUBLE) IGNORE NULLS) OVER ({part}ORDER BY row_id NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS Proteinuria,
       TRY_CAST({cr} AS DOUBLE) AS Creatinine,
       {yn('AceiYN')} AS Antihypertensive,
       ({yn('CsIm')}) | ({yn('AZA')}) | ({yn('CELLCEPT')}) AS Immunosuppressants,
       {yn('Fishoil')} AS FishOil,
       CASE ESKDcorretto WHEN '1' THEN 1 WHEN '0' THEN 0 END AS Eskd,
       'A' AS site
FROM fx_site_a"""


def _site_b_clean() -> str:
    yn = lambda c: (f"CASE {c} WHEN 'Y' THEN 1 WHEN 'Yes' THEN 1 WHEN '1' THEN 1 "  # noqa: E731
                    f"WHEN 'N' THEN 0 WHEN 'No' THEN 0 WHEN '0' THEN 0 END")
    return f"""
SELECT VALIGA_CODE, row_id,
       CASE SEX WHEN 'M' THEN 'M' WHEN 'F' THEN 'F' END AS Gender,
       CAST(age AS DOUBLE) AS Age,
       CAST(dateAssess AS INTEGER) AS dateAssess,
       CAST(coalesce(TRY_CAST(systolic AS DOUBLE) >= 140, false) OR coalesce(TRY_CAST(Diastolic AS DOUBLE) >= 90, false)
            AS INTEGER) AS Hypertension,
       M, E, S, T, C,
       last_value(TRY_CAST(Uprot AS DOUBLE) IGNORE NULLS) OVER (ORDER BY row_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Proteinuria,
       TRY_CAST(creat_mg_dl AS DOUBLE) AS Creatinine,
       CAST(coalesce(TRY_CAST(nb_of_bpmeds AS DOUBLE) > 0, false) AS INTEGER) AS Antihypertensive,
       {yn('Immunotherapies')} AS Immunosuppressants,
       {yn('fish_oil')} AS FishOil,
       CASE outcome WHEN 1 THEN 1 WHEN 0 THEN 0 END AS Eskd,
       'B' AS site
FROM fx_site_b"""


CTE["site_a_max"] = _site_a_clean("max")
CTE["site_a_min"] = _site_a_clean("min")
CTE["site_a_max_entity"] = _site_a_clean("max", "entity")
CTE["site_b"] = _site_b_clean()

COHORT_COLS = ("Code, Gender, Age, dateAssess, Hypertension, M, E, S, T, C, Proteinuria, Creatinine, "
               "Antihypertensive, Immunosuppressants, FishOil, Eskd")
_SITE_COLS = ("VALIGA_CODE AS Code, row_id, Gender, {age} AS Age, dateAssess, Hypertension, M, E, S, T, C, "
              "Proteinuria, Creatinine, Antihypertensive, Immunosuppressants, FishOil, Eskd, "
              "CASE site WHEN 'A' THEN 0 ELSE 1 END AS site_order")

CTE["visits_max"] = f"""
SELECT {_SITE_COLS.format(age='CAST(round_even(Age, 0) AS INTEGER)')} FROM site_a_max
UNION ALL
SELECT {_SITE_COLS.format(age='CAST(round_even(Age, 0) AS INTEGER)')} FROM site_b"""

CTE["visits_min"] = f"""
SELECT {_SITE_COLS.format(age='CAST(round_even(Age, 0) AS INTEGER)')} FROM site_a_min
UNION ALL
SELECT {_SITE_COLS.format(age='CAST(round_even(Age, 0) AS INTEGER)')} FROM site_b"""

CTE["cohort_max"] = f"""
SELECT {COHORT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY Code ORDER BY dateAssess DESC, site_order, row_id) AS rn
  FROM visits_max WHERE Code IS NOT NULL AND dateAssess IS NOT NULL) t WHERE rn = 1"""

CTE["cohort_min"] = f"""
SELECT {COHORT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY Code ORDER BY dateAssess, row_id) AS rn
  FROM ({_SITE_COLS.replace('{age}', 'Age').join(['SELECT ', ' FROM site_a_min'])}) a
  WHERE Code IS NOT NULL AND dateAssess IS NOT NULL) t WHERE rn = 1
UNION ALL
SELECT {COHORT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY Code ORDER BY dateAssess DESC, row_id) AS rn
  FROM ({_SITE_COLS.replace('{age}', 'Age').join(['SELECT ', ' FROM site_b'])}) b
  WHERE Code IS NOT NULL AND dateAssess IS NOT NULL) t WHERE rn = 1"""

# Cohort label / feature table shared by splits, metrics and training oracles.
CTE["cohort_xy"] = """
SELECT Code, CAST(coalesce(Eskd, 0) AS INTEGER) AS label, dateAssess FROM cohort_max"""

_DEPS = {
    "site_a_max": ["fx_site_a"], "site_a_min": ["fx_site_a"], "site_a_max_entity": ["fx_site_a"],
    "site_b": ["fx_site_b"],
    "visits_max": ["site_a_max", "site_b"], "visits_min": ["site_a_min", "site_b"],
    "cohort_max": ["visits_max"], "cohort_min": ["site_a_min", "site_b"],
    "cohort_xy": ["cohort_max"],
}


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named CTEs and their dependencies, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]}\n)" for n in order) + "\n" + body
