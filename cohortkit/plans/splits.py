"""Split, fold and rebalancing queries over the cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import sampling as SM
from cohortkit.operators import splits as SP
from cohortkit.operators import weighted as WT
from cohortkit.plans.cohort import cohort
from cohortkit.plans.oracle import CTE, _DEPS, with_ctes
from cohortkit.plans.registry import query
from cohortkit.session import cut_lineage

SEED = 42
K = 10
BATCH = 32


def cohort_xy(spark: SparkSession, sf: str) -> DataFrame:
    """Key, binary label (missing label -> 0, the reference's rule) and follow-up."""
    c = cohort(spark, sf, "max")
    return c.select("Code", F.coalesce("Eskd", F.lit(0)).cast("int").alias("label"), "dateAssess")


def strat(spark: SparkSession, sf: str) -> DataFrame:
    return SP.stratified_split(cohort_xy(spark, sf), "Code", "label", SEED, 0.2, K)


def train(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with their own fold; the model of fold f trains on the rows of the other folds."""
    return SP.train_rows(strat(spark, sf)).select("Code", "label", "fold")


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced draws for the model of every fold."""
    parts = SM.training_parts(cut_lineage(train(spark, sf), "train"), "fold", K)
    return SM.balanced_draws(parts, "Code", "label", SEED, BATCH, by=["fold"])


_H = "md5(concat('{seed}|', CAST({key} AS VARCHAR)))"

CTE["strat"] = f"""
SELECT r.Code, r.label, r.dateAssess,
       CAST(rk <= test_c AS INTEGER) AS is_test,
       CAST(CASE WHEN rk <= test_c THEN 0 ELSE (rk - test_c - 1 + off) % {K} + 1 END AS BIGINT) AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_H.format(seed=SEED, key='Code')}, Code) AS rk
      FROM cohort_xy) r
JOIN (SELECT label, train_c, n_c - train_c AS test_c,
             coalesce(sum(train_c) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM (SELECT label, n_c, fl + CASE WHEN pos <= need THEN 1 ELSE 0 END AS train_c
            FROM (SELECT *, ntr - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, label) AS pos
                  FROM (SELECT label, n_c, ntr, (ntr * n_c) // n AS fl, (ntr * n_c) % n AS rem
                        FROM (SELECT label, n_c, n, n - (n + 4) // 5 AS ntr
                              FROM (SELECT label, count(*) AS n_c, sum(count(*)) OVER () AS n
                                    FROM cohort_xy GROUP BY label) a) b) c) d) e) k
USING (label)"""
_DEPS["strat"] = ["cohort_xy"]

CTE["fold_train"] = f"""
SELECT s.Code, s.label, f.fold FROM strat s, (SELECT CAST(unnest(range(1, {K} + 1)) AS BIGINT) AS fold) f
WHERE s.is_test = 0 AND s.fold <> f.fold"""
_DEPS["fold_train"] = ["strat"]

_HEX60 = "CAST(CAST('0x' || substr(md5(concat('{tag}', CAST(draw_id AS VARCHAR))), 1, 15) AS BIGINT) AS HUGEINT)"
CTE["draws"] = f"""
SELECT dd.fold, dd.draw_id, r.Code, dd.label, dd.draw_id // {BATCH} AS batch_id
FROM (SELECT d.fold, d.draw_id, cls.label, CAST((d.hr * cls.nc) // 1152921504606846976 AS BIGINT) + 1 AS rk
      FROM (SELECT fold, draw_id, CAST(({_HEX60.format(tag=f'{SEED}|c|')} * nl) // 1152921504606846976 AS BIGINT) AS ci,
                   {_HEX60.format(tag=f'{SEED}|r|')} AS hr
            FROM (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY Code) - 1 AS draw_id FROM fold_train) t
            JOIN (SELECT fold, count(DISTINCT label) AS nl FROM fold_train GROUP BY fold) n USING (fold)) d
      JOIN (SELECT fold, label, count(*) AS nc, row_number() OVER (PARTITION BY fold ORDER BY label) - 1 AS ci
            FROM fold_train GROUP BY fold, label) cls USING (fold, ci)) dd
JOIN (SELECT fold, Code, label,
             row_number() OVER (PARTITION BY fold, label ORDER BY {_H.format(seed=f'{SEED}|row', key='Code')}, Code) AS rk
      FROM fold_train) r
  ON r.fold = dd.fold AND r.label = dd.label AND r.rk = dd.rk"""
_DEPS["draws"] = ["fold_train"]


@query("split_8020_stratified", with_ctes("SELECT Code, label, is_test, fold FROM strat", "strat"), "X1,X3,J1,J2")
def q_strat(spark, sf):
    return strat(spark, sf).select("Code", "label", "is_test", "fold")


@query("folds_stratified", with_ctes(f"""
SELECT Code, label, CAST((rk - 1 + off) % {K} + 1 AS BIGINT) AS fold
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_H.format(seed=SEED, key='Code')}, Code) AS rk
      FROM cohort_xy) r
JOIN (SELECT label, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM cohort_xy GROUP BY label) o USING (label)""", "cohort_xy"), "X3")
def q_folds_strat(spark, sf):
    return SP.stratified_folds(cohort_xy(spark, sf), "Code", "label", SEED, K).select("Code", "label", "fold")


@query("split_8020_plain", with_ctes(f"""
SELECT Code, label, CAST(rk <= (n + 4) // 5 AS INTEGER) AS is_test,
       CASE WHEN rk <= (n + 4) // 5 THEN 0 ELSE (rk - (n + 4) // 5 - 1) % {K} + 1 END AS fold
FROM (SELECT *, row_number() OVER (ORDER BY {_H.format(seed=123, key='Code')}, Code) AS rk, count(*) OVER () AS n
      FROM cohort_xy) r""", "cohort_xy"), "X2,X4")
def q_plain(spark, sf):
    return SP.plain_split(cohort_xy(spark, sf), "Code", 123, 0.2, K).select("Code", "label", "is_test", "fold")


@query("folds_plain", with_ctes(f"""
SELECT Code, label, CAST((row_number() OVER (ORDER BY {_H.format(seed=SEED, key='Code')}, Code) - 1) % {K} + 1 AS BIGINT)
       AS fold
FROM cohort_xy""", "cohort_xy"), "X4")
def q_folds_plain(spark, sf):
    return SP.plain_split(cohort_xy(spark, sf), "Code", SEED, 0.0, K).select("Code", "label", "fold")


@query("split_shape", with_ctes("""
SELECT CASE is_test WHEN 1 THEN 'test' ELSE 'train' END AS subset, count(*) AS n,
       count(CASE WHEN label = 1 THEN 1 END) AS n_pos,
       count(CASE WHEN dateAssess >= 5 * 365 THEN 1 END) AS n_5y,
       count(CASE WHEN dateAssess >= 10 * 365 THEN 1 END) AS n_10y
FROM strat GROUP BY 1""", "strat"), "A8,F2")
def q_split_shape(spark, sf):
    s = strat(spark, sf)
    return s.groupBy(F.when(F.col("is_test") == 1, "test").otherwise("train").alias("subset")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("label") == 1, 1)).alias("n_pos"),
        F.count(F.when(F.col("dateAssess") >= 5 * 365, 1)).alias("n_5y"),
        F.count(F.when(F.col("dateAssess") >= 10 * 365, 1)).alias("n_10y"))


@query("split_leak_check", with_ctes("""
SELECT (SELECT count(*) FROM strat a WHERE is_test = 0 AND Code IN (SELECT Code FROM strat WHERE is_test = 1))
       AS n_overlap""", "strat"), "X7")
def q_leak(spark, sf):
    s = strat(spark, sf)
    return SP.overlap_count(SP.train_rows(s), SP.test_rows(s), "Code")


@query("class_balance", with_ctes("""
SELECT fold, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY fold), 6) AS share
FROM fold_train GROUP BY fold, label""", "fold_train"), "A1")
def q_class_balance(spark, sf):
    return SM.class_counts(train(spark, sf), "label", "fold", K)


@query("class_weights", with_ctes("""
SELECT fold, label, count(*) AS n, round(1.0 / count(*), 9) AS weight FROM fold_train GROUP BY fold, label""",
                                  "fold_train"), "A6")
def q_class_weights(spark, sf):
    return SM.class_weights(train(spark, sf), "label", "fold", K)


@query("pos_weight", with_ctes("""
SELECT fold, count(CASE WHEN label = 0 THEN 1 END) AS n_neg, count(CASE WHEN label = 1 THEN 1 END) AS n_pos,
       round(CAST(count(CASE WHEN label = 0 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN label = 1 THEN 1 END), 0), 6)
       AS pos_weight
FROM fold_train GROUP BY fold""", "fold_train"), "A5")
def q_pos_weight(spark, sf):
    return SM.pos_weight(train(spark, sf), "label", "fold", K)


@query("balanced_draws", with_ctes("SELECT * FROM draws", "draws"), "X5,X6")
def q_draws(spark, sf):
    return draws(spark, sf).select("fold", "draw_id", "Code", "label", "batch_id")


@query("batch_balance", with_ctes("""
SELECT fold, batch_id, count(CASE WHEN label = 1 THEN 1 END) AS n_pos, count(CASE WHEN label = 0 THEN 1 END) AS n_neg
FROM draws GROUP BY fold, batch_id""", "draws"), "A9")
def q_batch_balance(spark, sf):
    return SM.batch_balance(draws(spark, sf), "label", by=["fold"])


@query("batches_shuffled", with_ctes(f"""
SELECT Code, (row_number() OVER (ORDER BY {_H.format(seed=SEED, key='Code')}, Code) - 1) // {BATCH} AS batch_id
FROM cohort_xy""", "cohort_xy"), "X6")
def q_batches(spark, sf):
    return SM.batches(cohort_xy(spark, sf).select("Code"), "Code", SEED, BATCH)


# --- X5 by row weight, X6 by epoch --------------------------------------------

EPOCHS = 3
_U60 = "CAST('0x' || substr(md5({t}), 1, 15) AS BIGINT)"


@query("weighted_draws", with_ctes(f"""
SELECT d.draw_id, r.Code FROM (
  SELECT i AS draw_id, CAST(({_U60.format(t=f"concat('{SEED}|w|', CAST(i AS VARCHAR))")}::HUGEINT * total) // 1152921504606846976 AS BIGINT) AS p
  FROM (SELECT unnest(range(0, count(*))) AS i, CAST(any_value(total) AS HUGEINT) AS total FROM (SELECT sum(greatest(dateAssess, 0)) OVER () AS total FROM cohort_xy) c) t) d
JOIN (SELECT Code, hi - w AS lo, hi FROM (
        SELECT Code, coalesce(greatest(dateAssess, 0), 0) AS w, CAST(sum(coalesce(greatest(dateAssess, 0), 0)) OVER (
               ORDER BY {_H.format(seed=f'{SEED}|row', key='Code')}, Code) AS BIGINT) AS hi FROM cohort_xy) c WHERE w > 0) r
  ON d.p >= r.lo AND d.p < r.hi""", "cohort_xy"), "X5 (any row weights: here days of follow-up)")
def q_weighted_draws(spark, sf):
    return WT.weighted_draws(cohort_xy(spark, sf), "Code", "dateAssess", SEED)


def _place_sql(src: str) -> str:
    """The place that the permutation gives x in every row of ``src`` (epoch, Code, x, n, a, b)."""
    def turn(r: int, half: str) -> str:
        t = f"concat_ws('|', '{SEED}', CAST(epoch AS VARCHAR), '{r}', CAST({half} AS VARCHAR))"
        return _U60.format(t=t)

    q = f"(SELECT *, x % a AS l, x // a AS r FROM {src}) q0"
    for i in range(WT.ROUNDS):
        one, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        q = f"(SELECT epoch, Code, n, a, b, {other}, ({one} + {turn(i, other)}) % {size} AS {one} FROM {q}) q{i + 1}"
    return f"SELECT epoch, Code, n, a, b, l + a * r AS x FROM {q}"


_RANKED = f"""(SELECT e.epoch, Code, rk - 1 AS x, n, a, (n + a - 1) // a AS b
 FROM (SELECT Code, row_number() OVER (ORDER BY {_H.format(seed=SEED, key='Code')}, Code) AS rk, count(*) OVER () AS n,
              CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS a FROM cohort_xy) c,
      (SELECT CAST(unnest(range(1, {EPOCHS} + 1)) AS BIGINT) AS epoch) e) r0"""


@query("batches_by_epoch", with_ctes("SELECT 1", "cohort_xy").rsplit("SELECT 1", 1)[0].rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""",
walk AS ({_place_sql(_RANKED)} UNION ALL {_place_sql("(SELECT * FROM walk WHERE x >= n) w0")})
SELECT epoch, Code, x AS position, x // {BATCH} AS batch_id FROM walk WHERE x < n""", "X6 (another order in every epoch, ranked once)")
def q_batches_by_epoch(spark, sf):
    return WT.epoch_batches(cohort_xy(spark, sf).select("Code"), "Code", SEED, EPOCHS, BATCH).select("epoch", "Code", "position", "batch_id")
