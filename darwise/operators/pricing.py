"""Unit-price model: features, split by time, boosted trees, median baseline, importance, scoring."""

import functools
import random
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window as W, functions as F

from darwise import values as V
from darwise.functions.text import month_index, month_start
from darwise.operators import boosting, trees
from darwise.operators.median import grouped_median
from darwise.sources.scratch import stored

_TARGET = "sale_price_sar"
_EPS = 2.220446049250313e-16  # smallest relative error of a double, the floor of a percentage base
_TREE_DEPTH = 4  # up to 16 leaves, the depth next to 15
_BINS = 255
ROWS_PER_TASK = 50_000  # training rows that a task goes over for each level of a tree
MOST_ROWS, TASKS = 1_000_000, 48  # beyond so many tasks these hold more rows each, up to so many: a fit is thousands of passes


class PricingReport(NamedTuple):
    n_train: int
    n_test: int
    test_start: str
    metrics: DataFrame  # predictor, mae, mape, r2
    by_project_mape: DataFrame  # project_name, mape
    importance: DataFrame  # feature, importance


def sales_features(sales: DataFrame, units: DataFrame, projects: DataFrame) -> DataFrame:
    """Sale with its unit and the project of the sale, month and model features."""
    u = units.select("unit_id", "unit_type", "bedrooms", "bathrooms", "area_sqm", "floor", "view", "parking_spaces", "list_price_sar")
    p = projects.select("project_id", F.col("name_en").alias("project_name"), F.col("city_en").alias("city"))
    s = sales.select("sale_id", "unit_id", "project_id", "sale_date", _TARGET, "discount_pct", "payment_method")
    joined = s.join(u, "unit_id").join(p, "project_id")
    return joined.drop("unit_id").withColumns(
        {
            "month": month_start("sale_date"),
            "month_index": month_index("sale_date"),
            "floor": F.coalesce("floor", F.lit(0)),
            "project_id": F.col("project_id").cast("string"),
        }
    )


def time_split(df: DataFrame, test_months: int = 6) -> tuple[DataFrame, DataFrame, str]:
    """Rows before and from the first of the last ``test_months`` months, and that month."""
    cutoff = df.agg(F.add_months(F.max("month"), 1 - test_months).alias("m")).first()["m"]
    start = F.lit(cutoff)
    return df.filter(F.col("month") < start), df.filter(F.col("month") >= start), "" if cutoff is None else f"{cutoff:%Y-%m}"


def _model_input(df: DataFrame) -> DataFrame:
    # A missing number is a value below all real ones, for a tree to split off.
    numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in V.PRICE_NUMERIC}
    return df.withColumns({**{c: F.col(c).cast("string") for c in V.PRICE_CATEGORICAL}, **numbers})


as_model_input = _model_input


def category_codes(train: DataFrame) -> StringIndexerModel:
    """Codes of the categories: the more frequent a value, the lower; unseen values share the code after the last."""
    codes = [f"_c_{c}" for c in V.PRICE_CATEGORICAL]
    return StringIndexer(inputCols=V.PRICE_CATEGORICAL, outputCols=codes, handleInvalid="keep").fit(_model_input(train))


def fit_tasks(rows: int) -> int:
    """How many tasks go over so many training rows for each level of a tree."""
    return max(1, min(-(-rows // ROWS_PER_TASK), TASKS), -(-rows // MOST_ROWS))


def fit_price_model(train: DataFrame, seed: int = 42, iterations: int = V.GBT_ITERATIONS) -> PipelineModel:
    """Boosted trees on log price. Categories unknown to training share one code of their own."""
    data = stored(_model_input(train).select(*V.PRICE_CATEGORICAL, *V.PRICE_NUMERIC, F.log(_TARGET).alias("_log_price")))
    rows, codes = data.count(), [f"_c_{c}" for c in V.PRICE_CATEGORICAL]
    # Every tree is several passes over the rows: as few tasks as the size of the table asks for.
    data = data.coalesce(fit_tasks(rows))
    indexer = category_codes(data)
    kinds = [len(labels) + 1 for labels in indexer.labelsArray]
    boosted = GBTRegressor(
        labelCol="_log_price",
        featuresCol="_features",
        predictionCol="_log_prediction",
        maxIter=iterations,
        stepSize=V.GBT_STEP,
        maxDepth=_TREE_DEPTH,
        minInstancesPerNode=V.GBT_MIN_LEAF,
        maxBins=max(_BINS, *kinds),
        seed=seed,
    )
    coding = PipelineModel([indexer, VectorAssembler(inputCols=codes + V.PRICE_NUMERIC, outputCol="_features")])
    fitted = boosting.fit(boosted, trees.with_vectors(coding, data), rows, kinds + [0] * len(V.PRICE_NUMERIC))
    return PipelineModel([*coding.stages, fitted])


def predict(model: PipelineModel, df: DataFrame, name: str = "predicted") -> DataFrame:
    """Add the predicted price."""
    kept = df.columns
    renamed = trees.scored(model, _model_input(df.withColumn("_row", F.struct(*kept))), "_log_prediction")
    return renamed.select("_row.*", F.exp("_log_prediction").alias(name))


def baseline_ppsqm(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Median price per sqm by project and unit type, and over all (one row)."""
    priced = stored(train.select("project_id", "unit_type", F.try_divide(_TARGET, "area_sqm").alias("ppsqm")))
    return grouped_median(priced, ["project_id", "unit_type"], "ppsqm", "ppsqm"), grouped_median(priced, [], "ppsqm", "global_ppsqm")


def predict_baseline(train: DataFrame, test: DataFrame, name: str = "baseline") -> DataFrame:
    """Add the baseline price: the group's median, or the overall one, times the area."""
    grouped, overall = baseline_ppsqm(train)
    fallback = overall.scalar()
    return test.join(grouped, ["project_id", "unit_type"], "left").withColumn(
        name, F.coalesce("ppsqm", fallback) * F.col("area_sqm")
    ).drop("ppsqm")


def _absolute_share(truth, prediction):
    return F.abs(truth - prediction) / F.greatest(F.abs(truth), F.lit(_EPS))


def regression_metrics(df: DataFrame, predictions: list[str], truth: str = _TARGET) -> DataFrame:
    """``(predictor, mae, mape, r2)``, one row per prediction column, from one aggregation."""
    y = F.col(truth)
    spread = F.count(y) * F.var_pop(y)
    one = df.agg(
        *[
            F.struct(
                F.lit(p).alias("predictor"),
                F.avg(F.abs(y - F.col(p))).alias("mae"),
                F.avg(_absolute_share(y, F.col(p))).alias("mape"),
                (1 - F.try_divide(F.sum((y - F.col(p)) * (y - F.col(p))), spread)).alias("r2"),
            ).alias(f"_{i}")
            for i, p in enumerate(predictions)
        ]
    )
    return one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(predictions))])))


def project_mape(df: DataFrame, prediction: str = "predicted") -> DataFrame:
    return df.groupBy("project_name").agg(F.avg(_absolute_share(F.col(_TARGET), F.col(prediction))).alias("mape"))


def shuffled_index(df: DataFrame, id_col: str = "sale_id", seed: int = 42) -> DataFrame:
    """``df`` with ``_at``, the row's place from 0 in an order that a hash of id and seed gives; ids are distinct.

    Rows are dealt out by ranges of the hash and numbered within a range; ranges
    begin where the ones before them end (one row per partition tells how many
    each holds). The order is the same on every run.
    """
    spark, by = df.sparkSession, F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed)))
    rows = df.withColumn("_by", by)
    ordered = rows.repartitionByRange("_by", id_col).sortWithinPartitions("_by", id_col).drop("_by")
    # The number that rows get holds partition and place; it is fixed by writing it.
    rows = stored(ordered.withColumn("_at", F.monotonically_increasing_id()))
    held = sorted((r["p"], r["n"]) for r in rows.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    base, bases = 0, []
    for part, n in held:
        bases.append((part, base))
        base += n
    first = spark.createDataFrame(bases, "_p long, _base long")
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_p", F.shiftright("_at", 33)).join(first, "_p").withColumn("_at", place).drop("_p", "_base")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


@functools.cache
def permutation(feature: str, repeat: int, seed: int = 42) -> tuple[int, int]:
    """``(a, b)``: row ``i`` of ``n`` takes the value of row ``(a * i + b) % n``; a prime above a billion, so no two rows share a donor."""
    rng = random.Random(f"{seed}-{feature}-{repeat}")
    a = rng.randrange(10**9, 2 * 10**9) | 1
    while not _is_prime(a):
        a += 2
    return a, rng.randrange(10**9)


def permutation_importance(model: PipelineModel, test: DataFrame, repeats: int = V.IMPORTANCE_REPEATS, seed: int = 42) -> DataFrame:
    """``(feature, importance)``: growth of the log-price error when a feature is shuffled.

    Each feature and repeat has a permutation of its own over the rows in hash
    order, so it is the same on every run and after a lost executor. Rows meet
    by place, one number for each feature and repeat; only the trees that look at
    a feature are gone through again when it is shuffled.
    """
    features = V.PRICE_CATEGORICAL + V.PRICE_NUMERIC
    coded = trees.with_features(model, _model_input(test).withColumn("_log_price", F.log(_TARGET)))
    rows = shuffled_index(coded.select("_log_price", F.col("_x").alias("own"), "sale_id"), seed=seed).select("_at", "_log_price", "own")
    n = max(1, rows.count())
    # Each row sends its numbers to the rows that take them and to its own place, so a place gets one number for each plan.
    plans = [F.struct(F.col("_at").alias("_to"), F.lit(i).alias("_plan"), c.alias("value")) for i, c in enumerate([F.col("_log_price"), *[F.col("own")[i] for i in range(len(features))]])]
    for i in range(len(features)):
        for repeat in range(repeats):
            a, b = permutation(features[i], repeat, seed)
            # The row that takes from this one: a is a prime above n, so it has an inverse.
            to = F.pmod(F.pmod(F.col("_at") - b, F.lit(n)) * pow(a, -1, n), F.lit(n))
            plans.append(F.struct(to.alias("_to"), F.lit(len(plans)).alias("_plan"), F.col("own")[i].alias("value")))
    met = rows.select(F.inline(F.array(*plans))).repartition("_to").sortWithinPartitions("_to", "_plan").select("value")
    errors = trees.shuffled_errors(model, met, len(features), repeats).groupBy("_v").agg((F.sum("total") / F.sum("n")).alias("mae"))
    base = F.max(F.when(F.col("_v") == 0, F.col("mae")))
    collected = errors.agg(base.alias("base"), F.collect_list(F.struct("_v", "mae")).alias("all"))
    names = F.array(*[F.lit(f) for f in features])
    return (
        collected.select("base", F.inline("all"))
        .filter(F.col("_v") > 0)
        .select(F.element_at(names, F.col("_v")).alias("feature"), (F.col("mae") - F.col("base")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def price_report(model: PipelineModel, df: DataFrame, test_months: int = 6, seed: int = 42) -> PricingReport:
    """Figures of a model fitted on what lies before the last months, measured on these."""
    train, test, start = time_split(df, test_months)
    n_test = test.count()
    if n_test < V.MIN_TEST_ROWS:
        raise ValueError("test set too small; reduce test_months")
    predicted = predict_baseline(train, predict(model, test))
    return PricingReport(
        n_train=train.count(),
        n_test=n_test,
        test_start=start,
        metrics=regression_metrics(predicted, ["predicted", "baseline"]),
        by_project_mape=project_mape(predicted),
        importance=permutation_importance(model, test, seed=seed),
    )


def train_price_model(
    df: DataFrame, test_months: int = 6, seed: int = 42, path: str | None = None, iterations: int = V.GBT_ITERATIONS
) -> tuple[PipelineModel, PricingReport]:
    """Fit on the past, measure on the last months; with ``path``, refit on all rows and store.

    The report keeps the figures measured before the refit.
    """
    df = stored(df)
    train, test, start = time_split(df, test_months)
    if test.count() < V.MIN_TEST_ROWS:
        raise ValueError("test set too small; reduce test_months")
    model = fit_price_model(train, seed, iterations)
    report = price_report(model, df, test_months, seed)
    if path is None:
        return model, report
    final = fit_price_model(df, seed, iterations)
    final.write().overwrite().save(f"{path}/model")
    report.metrics.withColumns(
        {"n_train": F.lit(report.n_train), "n_test": F.lit(report.n_test), "test_start": F.lit(start)}
    ).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    return final, report


def load_price_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def with_defaults(units: DataFrame, cities: dict[str, str] | None = None) -> DataFrame:
    """Unit descriptions completed for scoring; absent columns count as null."""
    cities = V.PROJECT_CITIES if cities is None else cities

    def given(name, kind):
        return F.col(name).cast(kind) if name in units.columns else F.lit(None).cast(kind)

    by_project = F.create_map(*[F.lit(x) for pair in cities.items() for x in pair])
    today = F.current_date()
    return units.withColumns(
        {
            "payment_method": F.coalesce(F.nullif(given("payment_method", "string"), F.lit("")), F.lit(V.DEFAULT_PAYMENT)),
            "floor": F.coalesce(given("floor", "int"), F.lit(0)),
            "month_index": F.coalesce(given("month_index", "int"), month_index(today)),
            "city": F.coalesce(
                F.nullif(given("city", "string"), F.lit("")),
                F.try_element_at(by_project, F.col("project_id").cast("string")),
                F.lit(V.DEFAULT_CITY),
            ),
            "bathrooms": F.coalesce(
                F.nullif(given("bathrooms", "int"), F.lit(0)), F.greatest(F.lit(1), given("bedrooms", "int") - 1)
            ),
        }
    )


def score_units(model: PipelineModel, units: DataFrame, cities: dict[str, str] | None = None) -> DataFrame:
    """Add ``estimated_price_sar`` and ``price_per_sqm``, rounded."""
    scored = predict(model, with_defaults(units, cities), "_p")
    return scored.withColumns(
        {
            "estimated_price_sar": F.round("_p").cast("bigint"),
            "price_per_sqm": F.round(F.try_divide("_p", "area_sqm")).cast("bigint"),
        }
    ).drop("_p")
