"""Trees scored as arrays against Spark's own scoring."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from darwise import values as V
from darwise.operators import boosting, pricing as P, trees


@pytest.fixture(scope="module")
def sold(spark):
    rng = random.Random(5)
    rows = [
        (i, *[rng.choice("abcd") for _ in V.PRICE_CATEGORICAL], *[float(rng.randint(1, 40)) if rng.random() > 0.05 else None for _ in V.PRICE_NUMERIC])
        for i in range(1500)
    ]
    kinds = "sale_id long, " + ", ".join([f"{c} string" for c in V.PRICE_CATEGORICAL] + [f"{c} double" for c in V.PRICE_NUMERIC])
    numbers = sum(F.coalesce(F.col(c), F.lit(3.0)) for c in V.PRICE_NUMERIC)
    price = F.when(F.col(V.PRICE_CATEGORICAL[0]) == "a", 2.0).otherwise(1.0) * (100 + numbers)
    return spark.createDataFrame(rows, kinds).withColumn("sale_price_sar", price).localCheckpoint()


@pytest.fixture(scope="module")
def model(sold):
    return P.fit_price_model(sold, iterations=12)


def test_scored_as_spark_scores(sold, model):
    odd = sold.withColumn(V.PRICE_CATEGORICAL[0], F.when(F.col("sale_id") % 9 == 0, "unseen").otherwise(F.col(V.PRICE_CATEGORICAL[0])))
    both = trees.scored(model, model.transform(P.as_model_input(odd)).drop("_features", "_log_prediction2", *[f"_c_{c}" for c in V.PRICE_CATEGORICAL]), "own")
    rows = both.select("own", "_log_prediction").collect()
    assert len(rows) == 1500 and len({round(r["own"], 6) for r in rows}) > 20
    assert [r["own"] for r in rows] == pytest.approx([r["_log_prediction"] for r in rows], abs=1e-12)


def test_importance_by_its_definition(sold, model):
    """every feature and repeat shuffled by its permutation and scored by Spark"""
    repeats, features = 2, V.PRICE_CATEGORICAL + V.PRICE_NUMERIC
    rows = P.shuffled_index(P.as_model_input(sold).withColumn("y", F.log("sale_price_sar")))
    held = {r["_at"]: r.asDict() for r in rows.collect()}
    n, asked = len(held), []
    for at, row in held.items():
        asked.append((-1, row["y"], *[row[f] for f in features]))
        for i, f in enumerate(features):
            for repeat in range(repeats):
                a, b = P.permutation(f, repeat)
                asked.append((i, row["y"], *[held[(a * at + b) % n][g] if g == f else row[g] for g in features]))
    frame = sold.sparkSession.createDataFrame(asked, "i int, y double, " + ", ".join([f"{c} string" for c in V.PRICE_CATEGORICAL] + [f"{c} double" for c in V.PRICE_NUMERIC]))
    mae = {r["i"]: r["m"] for r in model.transform(frame).groupBy("i").agg(F.avg(F.abs(F.col("y") - F.col("_log_prediction"))).alias("m")).collect()}
    out = {r["feature"]: r["importance"] for r in P.permutation_importance(model, sold, repeats).collect()}
    assert out == pytest.approx({f: mae[i] - mae[-1] for i, f in enumerate(features)}, abs=1e-12)
    assert max(out.values()) > 0.01


def test_tasks_of_a_fit_stay_few():
    assert [P.fit_tasks(n) for n in (0, 50_000, 50_001, 4_500_000, 27_000_000)] == [1, 1, 2, 48, 48]
    assert P.fit_tasks(100_000_000) == 100


def nodes(model):
    return [(weight, root) for weight, _, root in trees.read_trees(model)]


def close(a, b):
    if isinstance(a, float):
        return a == pytest.approx(b, abs=1e-12)
    test = a[1] == b[1] if isinstance(a[1], float) else list(a[1]) == list(b[1])
    return not isinstance(b, float) and a[0] == b[0] and test and close(a[2], b[2]) and close(a[3], b[3])


def test_trees_are_those_that_spark_grows(sold):
    """one task, and several whose tallies the driver adds up; nothing of Spark's own boosting runs over the rows"""
    data = P.as_model_input(sold).withColumn("_log_price", F.log("sale_price_sar"))
    coded = PipelineModel([P.category_codes(sold), VectorAssembler(inputCols=[f"_c_{c}" for c in V.PRICE_CATEGORICAL] + V.PRICE_NUMERIC, outputCol="_features")])
    asked = GBTRegressor(labelCol="_log_price", featuresCol="_features", maxIter=44, stepSize=0.05, maxDepth=4, minInstancesPerNode=10, maxBins=255, seed=42)
    rows = trees.with_vectors(coded, data).select("_features", "_x", "_log_price").localCheckpoint()
    kinds = [len(x) + 1 for x in coded.stages[0].labelsArray] + [0] * len(V.PRICE_NUMERIC)
    own = nodes(asked.fit(rows))
    for parts in (1, 3):
        made = boosting.fit(asked, rows.coalesce(parts), 1500, kinds)
        assert made.getNumTrees == 44 and made.numFeatures == len(kinds)
        assert all(w == v and close(a, b) for (w, a), (v, b) in zip(nodes(made), own, strict=True)), parts
    with pytest.raises(Exception, match="must not be null"):
        boosting.fit(asked, rows.withColumn("_log_price", F.when(F.rand(1) < 0.9, F.col("_log_price"))).coalesce(1), 1500, kinds)


def test_bounds_split_rows_into_equal_parts():
    values, counts = np.arange(1000.0), np.ones(1000, int)
    bounds = boosting.split_points(values, counts, 9)
    assert len(bounds) == 9 and np.diff(bounds) == pytest.approx([100] * 8)
    assert list(boosting.split_points(np.array([1.0, 4.0, 5.0]), np.array([9, 1, 1]), 9)) == [2.5, 4.5]


def test_trees_of_many_leaves():
    """leaves as bits of a number, beyond 16, and trees that have more of them than it has bits"""
    rng = np.random.default_rng(3)

    def grown(depth):
        if not depth:
            return float(rng.normal())
        feature = int(rng.integers(0, 3))
        return feature, rng.random(5) < 0.5 if feature == 2 else float(rng.integers(0, 6)), grown(depth - 1), grown(depth - 1)

    many = [(0.5, {0, 1, 2}, grown(depth)) for depth in (0, 2, 4, 5, 7)]
    x = np.array([rng.integers(0, 7, 500) / 1.0, rng.integers(-1, 7, 500) / 2, rng.integers(0, 5, 500) / 1.0])
    bounds, made = trees.tables(many, 3)
    assert [values is None for values, _ in made] == [False] * 4 + [True]
    for (weight, _, root), (values, by_feature) in zip(many, made):
        got = trees._value(values, by_feature, trees._places(bounds, x), x)
        assert np.broadcast_to(got, 500).tolist() == np.broadcast_to(weight * trees.tree_values(root, x), 500).tolist()
