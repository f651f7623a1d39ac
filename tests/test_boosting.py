"""Boosting over histograms: the model of Spark's GBT, whatever the tasks."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pulsegrid.operators import boosting
from pulsegrid.operators.boosting import HistogramBoosting


@pytest.fixture(scope="module")
def data(spark):
    x = [((F.xxhash64("id", F.lit(i)) % 1000 + 1000) / 1000).alias(f"x{i}") for i in range(3)]
    rows = spark.range(40_000).select("id", *x, (F.col("id") % 5).cast("double").alias("few"))
    y = ((F.col("x0") > 0.9) & (F.col("few") >= 2)) | (F.col("x1") + F.col("x2") > 2.9)
    noise = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(20)) == 0
    return rows.withColumn("label", (y != noise).cast("double"))


def fit(df, stage):
    return Pipeline(stages=[VectorAssembler(inputCols=["x0", "x1", "x2", "few"], outputCol="features"), stage]).fit(df)


def test_as_good_as_sparks_trees(data, tmp_path):
    tr, va = data.where("id % 4 > 0"), data.where("id % 4 = 0")
    models = [fit(tr, s(maxDepth=5, maxIter=12, stepSize=0.1)) for s in (HistogramBoosting, GBTClassifier)]
    models[0].write().save(str(tmp_path / "m"))
    ours, theirs = (m.transform(va) for m in (PipelineModel.load(str(tmp_path / "m")), models[1]))
    area = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate
    assert area(ours) == pytest.approx(area(theirs), abs=0.01)
    both = ours.select("id", "prediction", "probability").join(
        theirs.select("id", F.col("prediction").alias("p")), "id")
    assert both.where("prediction = p").count() >= 0.99 * va.count()


def test_rows_dealt_otherwise_give_the_same_model(data):
    one = fit(data.coalesce(1), HistogramBoosting(maxIter=3)).stages[-1]
    many = fit(data.repartition(7), HistogramBoosting(maxIter=3)).stages[-1]
    assert len(one.getOrDefault("trees")) == 3
    if one.getOrDefault("edges") == many.getOrDefault("edges"):  # quantiles may differ a little
        assert one.getOrDefault("trees") == many.getOrDefault("trees")
    assert one.getOrDefault("edges")[3] == many.getOrDefault("edges")[3] == [0.5, 1.5, 2.5, 3.5]


def test_histograms_are_exact_sums():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 32, (3, 5000)).astype(np.uint16)
    codes = np.stack([bins[0] | bins[1] << 5, bins[2]]).astype(np.uint16)
    g = (np.rint(rng.uniform(-4, 4, 5000) * 2 ** 18) / 2 ** 18).astype(np.float32)
    splits = [(np.array([2]), np.array([11]))]
    got = next(boosting._histogram(splits, 1, 3)([(codes, None, None, g)]))
    for side in (0, 1):
        mine = (bins[2] > 11) == bool(side)
        for f in range(3):
            for b in range(32):
                hit = mine & (bins[f] == b)
                assert (got[0, side, f, b], got[1, side, f, b]) == (hit.sum(), g[hit].astype(float).sum())


def test_one_label_and_no_rows(spark):
    df = spark.range(50).select(*[F.col("id").cast("double").alias(c) for c in ("x0", "x1", "x2", "few")],
                                F.lit(1.0).alias("label"))
    assert fit(df, HistogramBoosting(maxIter=2)).transform(df).where("prediction = 1").count() == 50
    with pytest.raises(ValueError, match="no rows"):
        fit(df.limit(0), HistogramBoosting(maxIter=2))
