"""Split invariants: exact sizes, disjoint, independent of partitioning."""
import math

from pyspark.sql import functions as F

from cohortkit.operators import ranking as RK
from cohortkit.operators import sampling as SM
from cohortkit.operators import splits as SP


def _frame(spark, n=400, pos=80):
    rows = [(i, 1 if i < pos else 0) for i in range(n)]
    return spark.createDataFrame(rows, "key long, label int")


def test_stratified_sizes_and_folds(spark):
    df = _frame(spark)
    s = SP.stratified_split(df, "key", "label", 42, 0.2, 10)
    counts = {(r.is_test, r.label): r.n for r in s.groupBy("is_test", "label").agg(F.count("*").alias("n")).collect()}
    assert counts[(1, 1)] + counts[(1, 0)] == math.ceil(0.2 * 400)
    assert counts[(1, 1)] == 16 and counts[(0, 1)] == 64
    folds = s.where("is_test = 0").groupBy("fold").agg(F.count("*").alias("n"),
                                                       F.sum("label").alias("p")).collect()
    assert sorted(r.n for r in folds) == [32] * 10
    assert sum(r.p for r in folds) == 64 and {r.p for r in folds} <= {6, 7}


def test_stratified_folds_sizes(spark):
    # 400 rows, 80 positives -> ten folds of 40 rows with 8 positives each
    s = SP.stratified_folds(_frame(spark), "key", "label", 7, 10)
    rows = s.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()
    assert sorted((r.n, r.p) for r in rows) == [(40, 8)] * 10


def test_split_independent_of_partitioning(spark):
    df = _frame(spark, 1000, 150)
    ref = None
    for parts in (1, 7, 64):
        s = SP.stratified_split(df.repartition(parts), "key", "label", 123, 0.2, 10)
        got = sorted((r.key, r.is_test, r.fold) for r in s.collect())
        ref = ref or got
        assert got == ref


def test_hash_rank_equals_global_row_number(spark):
    from pyspark.sql import Window
    df = _frame(spark, 3000, 900)
    two = RK.hash_rank(df, "key", 5, by=["label"], out="rk", prefix=2)
    w = Window.partitionBy("label").orderBy(RK.hash_key(5, "key"), "key")
    one = df.withColumn("rk", F.row_number().over(w))
    assert sorted(map(tuple, two.select("key", "rk").collect())) == sorted(map(tuple, one.select("key", "rk").collect()))


def test_leak_check_zero(spark):
    s = SP.plain_split(_frame(spark), "key", 1, 0.2, 5)
    assert SP.overlap_count(SP.train_rows(s), SP.test_rows(s), "key").first().n_overlap == 0
    assert s.where("is_test = 1").count() == 80


def test_balanced_draws_exact_n_and_balance(spark):
    df = _frame(spark, 2000, 200)
    d = SM.balanced_draws(df, "key", "label", 42, 32)
    assert d.count() == 2000
    pos = d.where("label = 1").count()
    assert 850 < pos < 1150          # classes equally likely
    assert d.agg(F.max("batch_id")).first()[0] == (2000 - 1) // 32


def test_carry_forward_matches_window(spark):
    from pyspark.sql import Window
    rows = [(i, None if i % 3 else float(i)) for i in range(1, 5000)]
    df = spark.createDataFrame(rows, "rid long, v double")
    got = RK.carry_forward(df, "v", "rid", bits=(6, 9))
    w = Window.orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("v", F.last("v", ignorenulls=True).over(w))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_rows_with_missing_keys_stay(spark):
    rows = [(1, 0, 1.0), (2, None, None), (None, 1, 3.0), (None, None, None), (4, 1, None)]
    df = spark.createDataFrame(rows, "key long, label int, v double")
    for out in (SP.stratified_split(df, "key", "label"), SP.plain_split(df, "key"), SP.stratified_folds(df, "key", "label", k=2),
                RK.carry_forward(df, "v", "key"), RK.carry_forward(df, "v", "key", by=["label"]), RK.hash_rank(df, "key", 1, by=["label"]),
                RK.running_total(df.fillna(0, ["v"]), "v", ["key"], F.floor(F.col("key") / 2), by=["label"])):
        assert out.count() == 5
    filled = {(r.key, r.label): r.v for r in RK.carry_forward(df, "v", "key").collect()}
    assert filled == {(1, 0): 1.0, (2, None): 1.0, (None, 1): 3.0, (None, None): None, (4, 1): 1.0}


def test_carry_forward_of_sparse_ids(spark):
    """Row ids far apart: the carry crosses buckets of every level, and no window covers more than the coarsest buckets."""
    ids = [3, 1 << 17, (1 << 18) + 1, 1 << 30, (1 << 40) + 5, 1 << 45, 1 << 61, (1 << 61) + 1]
    df = spark.createDataFrame([(i, float(n) if n in (0, 3) else None) for n, i in enumerate(ids)], "rid long, v double")
    got = [r.v for r in RK.carry_forward(df, "v", "rid").orderBy("rid").collect()]
    assert got == [0.0, 0.0, 0.0, 3.0, 3.0, 3.0, 3.0, 3.0]


def test_counts_beyond_32_bits(spark):
    """Ten thousand million rows a class go through quotas, draws and AUC without overflow."""
    from cohortkit.operators import metrics as MT
    n = 10_000_000_001
    sizes = spark.createDataFrame([(0, 3 * n), (1, n)], "label int, n_group long")
    q = {r.label: r for r in SP.class_quotas(sizes, "label", 0.2).collect()}
    n_test = -(-4 * n // 5)
    assert q[0].test_c + q[1].test_c == n_test and q[0].train_c == (4 * n - n_test) * 3 * n // (4 * n)
    counts = spark.createDataFrame([(0.2, 0, n), (0.4, n, n), (-3.5, 5, 0)], "prob double, pos long, neg long")
    auc = MT.auc_from_counts(counts, "prob").first().auc
    assert abs(auc - (n * (n + n / 2)) / ((n + 5) * 2 * n)) < 1e-6
    h, big = F.lit((1 << 60) - 1), F.lit(n * 1000)
    assert spark.range(1).select(RK.scaled(h, big)).first()[0] == ((1 << 60) - 1) * n * 1000 >> 60


def test_draws_per_fold_are_balanced(spark):
    df = _frame(spark, 600, 60)
    s = SP.stratified_split(df, "key", "label", 42, 0.2, 4)
    train = SP.train_rows(s).select("key", "label", "fold")
    d = SM.balanced_draws(SM.training_parts(train, "fold", 4), "key", "label", 7, 32, by=["fold"])
    sizes = {r.fold: r.n for r in d.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sizes == {f: 360 for f in range(1, 5)}
    own = {(r.key, r.fold) for r in train.collect()}
    assert not any((r.key, r.fold) in own for r in d.collect())
    assert {r.fold for r in SM.pos_weight(train, "label", "fold", 4).collect()} == {1, 2, 3, 4}


def test_draws_broadcast_no_rows(spark, tmp_path):
    """A stored table counts as small as its file; the rows that are ranked and drawn are shuffled all the same."""
    df = _frame(spark, 5000, 500).withColumn("fold", F.col("key") % 4 + 1)
    df.write.parquet(str(tmp_path / "train"))
    train = spark.read.parquet(str(tmp_path / "train"))
    draws = SM.balanced_draws(SM.training_parts(train, "fold", 4), "key", "label", 7, 32, by=["fold"])
    plan = draws._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and plan.count("SortMergeJoin") >= 1
    assert draws.count() == 15000
    ranked = RK.hash_rank(train, "key", 5, by=["label"])._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in ranked
