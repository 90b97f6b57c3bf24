"""Property tests: the two-level operators equal the naive global windows."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortkit.operators import metrics as MT
from cohortkit.operators import ranking as RK

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.floats(-5, 5, allow_nan=False))),
                min_size=1, max_size=300),
       st.integers(1, 5))
def test_carry_forward_property(spark, rows, bits):
    data = [(i, g, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "rid long, g int, v double")
    for by in ([], ["g"]):
        got = RK.carry_forward(df, "v", "rid", by=by, bits=(bits, bits + 2))
        w = Window.partitionBy(*by).orderBy("rid").rowsBetween(Window.unboundedPreceding, 0)
        exp = df.withColumn("v", F.last("v", ignorenulls=True).over(w))
        assert sorted(map(tuple, got.select("rid", "g", "v").collect())) == \
            sorted(map(tuple, exp.select("rid", "g", "v").collect()))


@SETTINGS
@given(st.lists(st.integers(0, 2), min_size=1, max_size=400), st.integers(0, 99), st.integers(1, 3))
def test_hash_rank_property(spark, labels, seed, prefix):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(labels)], "k long, c int")
    got = RK.hash_rank(df, "k", seed, by=["c"], out="r", size_col="n", prefix=prefix)
    w = Window.partitionBy("c").orderBy(RK.hash_key(seed, "k"), "k")
    exp = df.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("c")))
    assert sorted(map(tuple, got.select("k", "c", "r", "n").collect())) == \
        sorted(map(tuple, exp.select("k", "c", "r", "n").collect()))


def test_auc_equals_spark_evaluator(spark, sf):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from cohortkit.plans.evaluation import scores
    s = scores(spark, sf).where("fold = 3")
    ours = MT.auc(s, "y", "prob").first().auc
    ev = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="prob", numBins=0)
    ref = ev.evaluate(s.withColumn("y", F.col("y").cast("double")))
    assert abs(ours - ref) < 1e-6
