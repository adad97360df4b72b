"""Monthly absorption per project: series, forecasters, backtest, forecast.

Sales are folded to one row per project and month before anything else, so a
project's series is as short as the calendar however many units it sold; from
there each project is one row with an array, and the forecasters are Column
functions over it.
"""

from pyspark.sql import Column, DataFrame, functions as F

from darwise import values as V
from darwise.functions.stages import compute_once, let
from darwise.functions.text import col, month_start


def monthly_absorption(sales: DataFrame, projects: DataFrame) -> DataFrame:
    """``(project_id, month, units)``, dense between the first and last sale month of all projects.

    Months before a project's launch are null; projects without a sale have no rows.
    """
    counts = sales.groupBy("project_id", month_start("sale_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.struct(F.min("month").alias("first"), F.max("month").alias("last"))).scalar()
    months = counts.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("month", "n"))).alias("by_month"))
    launch = F.to_date(F.concat("launch_month", F.lit("-01")))
    launches = projects.select("project_id", launch.alias("launch"))
    grid = (
        months.join(launches, "project_id", "left")
        .withColumn("month", F.explode(F.sequence(span["first"], span["last"], F.expr("interval 1 month"))))
    )
    units = F.coalesce(F.try_element_at("by_month", "month"), F.lit(0))
    applies = F.col("launch").isNull() | (F.col("month") >= F.col("launch"))
    return grid.select("project_id", "month", F.when(applies, units).alias("units"))


# --- forecasters: month-ordered array<double> in, array<double> of ``h`` out ---
def _floored(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def _doubles(y) -> Column:
    return col(y).cast("array<double>")


def naive_last(y, h: int) -> Column:
    return F.array_repeat(_floored(F.element_at(_doubles(y), -1)), h)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_3(y, h: int) -> Column:
    last = F.slice(_doubles(y), F.greatest(F.size(col(y)) - 2, F.lit(1)), F.lit(3))
    return F.array_repeat(_floored(let(last, _mean)), h)


def _damped_states(y: Column, alpha: float, beta: float, phi: float) -> Column:
    """``struct<level, trend, ahead>``: the fit, and the one-step forecast before each later month."""
    empty = F.array().cast("array<double>")
    trend0 = F.when(F.size(y) > 1, F.get(y, F.lit(1)) - F.get(y, F.lit(0))).otherwise(F.lit(0.0))
    start = F.struct(F.get(y, F.lit(0)).alias("level"), trend0.alias("trend"), empty.alias("ahead"))

    def step(s, x):
        return let(
            alpha * x + (1 - alpha) * (s["level"] + phi * s["trend"]),
            lambda level: F.struct(
                level.alias("level"),
                (beta * (level - s["level"]) + (1 - beta) * phi * s["trend"]).alias("trend"),
                F.concat(s["ahead"], F.array(_floored(s["level"] + phi * s["trend"]))).alias("ahead"),
            ),
        )

    return F.aggregate(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), start, step)


def _damped_path(state: Column, h: int, phi: float) -> Column:
    reach, steps = 0.0, []
    for k in range(1, h + 1):
        reach += phi**k
        steps.append(_floored(state["level"] + reach * state["trend"]))
    return F.array(*steps)


def damped_trend(
    y, h: int, alpha: float = V.DAMPED_ALPHA, beta: float = V.DAMPED_BETA, phi: float = V.DAMPED_PHI
) -> Column:
    """Linear trend that fades; the second month both starts the trend and is smoothed in."""
    return let(_damped_states(_doubles(y), alpha, beta, phi), lambda s: _damped_path(s, h, phi))


def series_of(monthly: DataFrame) -> DataFrame:
    """One row per project: its applicable months in order, ``months`` and ``y``."""
    entries = F.array_sort(F.collect_list(F.when(F.col("units").isNotNull(), F.struct("month", F.col("units").cast("double").alias("units")))))
    return monthly.groupBy("project_id").agg(entries.alias("_e")).select(
        "project_id", F.col("_e.month").alias("months"), F.col("_e.units").alias("y")
    )


def backtest(monthly: DataFrame, window: int = 6) -> DataFrame:
    """Mean absolute one-step error of each method over the last ``window`` months.

    All origins come from one walk through the series. Projects with fewer than
    ``window + 3`` months are left out.
    """
    s = series_of(monthly).filter(F.size("y") >= window + 3)
    s = compute_once(
        s, {"_fit": _damped_states(F.col("y"), V.DAMPED_ALPHA, V.DAMPED_BETA, V.DAMPED_PHI)}
    )
    origins = F.sequence(F.size("y") - window + 1, F.size("y"))  # position, from 1, of the month to hit

    def error(prediction):
        return let(F.transform(origins, lambda p: F.abs(prediction(p) - F.element_at("y", p.cast("int")))), _mean)

    errors = {
        "naive_last": error(lambda p: _floored(F.element_at("y", (p - 1).cast("int")))),
        "mean_3": error(lambda p: _floored(let(F.slice("y", (p - 3).cast("int"), F.lit(3)), _mean))),
        "damped_trend": error(lambda p: F.element_at("_fit.ahead", (p - 1).cast("int"))),
    }
    return compute_once(s, {f"mae_{m}": errors[m] for m in V.FORECAST_METHODS}, ["project_id", "months", "y", "_fit"])


def best_method() -> Column:
    """The method of least error; of equal ones (to nine digits) the first of the list."""
    ranked = F.array(
        *[F.struct(F.round(f"mae_{m}", 9).alias("mae"), F.lit(i).alias("i"), F.lit(m).alias("method")) for i, m in enumerate(V.FORECAST_METHODS)]
    )
    return F.array_min(ranked)["method"]


def forecast_absorption(monthly: DataFrame, remaining: DataFrame, horizon: int = 6, window: int = 6) -> DataFrame:
    """Per project: best method, errors, forecast months and units, stock and months of inventory."""
    tested = compute_once(backtest(monthly, window), {"method": best_method()})
    path = (
        F.when(F.col("method") == "naive_last", naive_last("y", horizon))
        .when(F.col("method") == "mean_3", mean_3("y", horizon))
        .otherwise(_damped_path(F.col("_fit"), horizon, V.DAMPED_PHI))
    )
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.add_months(F.element_at("months", -1), k))
    tested = compute_once(tested, {"path": path, "ahead": ahead})
    mean = let(F.col("path"), _mean)
    joined = tested.join(remaining, "project_id", "left").withColumn(
        "remaining_units", F.coalesce("remaining_units", F.lit(0))
    )
    last_3 = F.slice("y", F.greatest(F.size("y") - 2, F.lit(1)), F.lit(3))
    return joined.select(
        "project_id",
        "method",
        F.struct(*[F.col(f"mae_{m}").alias(m) for m in V.FORECAST_METHODS]).alias("backtest_mae"),
        last_3.cast("array<bigint>").alias("last_3_months"),
        F.zip_with("ahead", "path", lambda m, u: F.struct(m.alias("month"), u.alias("units"))).alias("forecast"),
        "remaining_units",
        F.when(mean > V.MIN_MONTHLY_SALES, F.try_divide("remaining_units", mean)).alias("months_of_inventory"),
    )


def absorption_report(forecasts: DataFrame) -> DataFrame:
    """Forecasts as reported: one decimal."""
    rounded = F.transform("forecast", lambda e: F.struct(e["month"].alias("month"), F.round(e["units"], 1).alias("units")))
    return forecasts.withColumns(
        {"forecast": rounded, "months_of_inventory": F.round("months_of_inventory", 1)}
    )
