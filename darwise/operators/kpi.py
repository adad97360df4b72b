"""Sales figures: status totals, revenue, momentum, breakdowns, unit statistics.

``units``, ``sales`` and ``projects`` have the columns of ``sources.files``.
"""

from pyspark.sql import DataFrame, functions as F

from darwise.functions.text import months_back, quarter_start
from darwise.operators.median import grouped_median
from darwise.sources.scratch import stored

_STATUSES = ["available", "reserved", "sold"]


def _status_counts():
    return [F.count_if(F.col("status") == s).alias(s) for s in _STATUSES]


def _share(part, total):
    return F.round(F.try_divide(100 * F.col(part), F.col(total)), 1)


def status_totals(units: DataFrame) -> DataFrame:
    """total, available, reserved, sold and the sold share in percent."""
    counts = units.agg(F.count(F.lit(1)).alias("total"), *_status_counts())
    return counts.withColumn("sold_pct", _share("sold", "total"))


def sales_totals(sales: DataFrame) -> DataFrame:
    """Revenue, average discount and the date of the last sale."""
    return sales.agg(
        F.round(F.sum("sale_price_sar")).alias("revenue_sar_total"),
        F.round(F.avg("discount_pct"), 2).alias("avg_discount_pct"),
        F.max("sale_date").alias("as_of"),
    )


def momentum(sales: DataFrame, months: int = 3) -> DataFrame:
    """Units and revenue of the last ``months`` before the last sale, and units of as many before.

    Sales are folded to one row per day. The days of the calendar are few, so
    they stand next to the last one in a single row and are looked at there:
    the sales table is read once.
    """
    days = sales.groupBy("sale_date").agg(F.count(F.lit(1)).alias("n"), F.sum("sale_price_sar").alias("revenue"))
    calendar = days.agg(F.max("sale_date").alias("last"), F.collect_list(F.struct("sale_date", "n", "revenue")).alias("days"))
    calendar = calendar.select(
        months_back("last", months).alias("recent_from"),
        months_back("last", 2 * months).alias("before_from"),
        F.inline("days"),
    )
    recent = F.col("sale_date") >= F.col("recent_from")
    before = ~recent & (F.col("sale_date") >= F.col("before_from"))
    return calendar.agg(
        F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("units_sold"),
        F.round(F.sum(F.when(recent, F.col("revenue")))).alias("revenue_sar"),
        F.coalesce(F.sum(F.when(before, F.col("n"))), F.lit(0)).alias("units_sold_previous"),
    )


def by_project(units: DataFrame, sales: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project name: units, sold, available, average price and price per sqm of sold units."""
    sold = F.col("status") == "sold"
    price = F.col("sale_price_sar")
    per_id = (
        units.select("unit_id", "project_id", "status", "area_sqm")
        .join(sales.select("unit_id", "sale_price_sar"), "unit_id", "left")
        .groupBy("project_id")
        .agg(
            F.count_if(sold).alias("sold"),
            F.count_if(F.col("status") == "available").alias("available"),
            F.sum(F.when(sold, price)).alias("_price"),
            F.count(F.when(sold, price)).alias("_prices"),
            F.sum(F.when(sold, F.try_divide(price, "area_sqm"))).alias("_ppsqm"),
            F.count(F.when(sold, F.try_divide(price, "area_sqm"))).alias("_ppsqms"),
        )
    )
    # Units and sales are reduced to one row per project before names come in.
    return (
        per_id.join(projects.select("project_id", "name_en", "total_units"), "project_id")
        .groupBy(F.col("name_en").alias("project"))
        .agg(
            F.max("total_units").alias("total_units"),
            F.sum("sold").alias("sold"),
            F.sum("available").alias("available"),
            F.round(F.try_divide(F.sum("_price"), F.sum("_prices"))).alias("avg_sale_price_sar"),
            F.round(F.try_divide(F.sum("_ppsqm"), F.sum("_ppsqms"))).alias("avg_price_per_sqm"),
        )
        .orderBy(F.desc("sold"), "project")
    )


def by_unit_type(sales: DataFrame, units: DataFrame) -> DataFrame:
    """Units sold and average price per unit type, most sold first."""
    return (
        sales.select("unit_id", "sale_price_sar")
        .join(units.select("unit_id", "unit_type"), "unit_id")
        .groupBy("unit_type")
        .agg(F.count(F.lit(1)).alias("units_sold"), F.round(F.avg("sale_price_sar")).alias("avg_sale_price_sar"))
        .orderBy(F.desc("units_sold"), "unit_type")
    )


def financing_mix(sales: DataFrame) -> DataFrame:
    return sales.groupBy("payment_method").agg(F.count(F.lit(1)).alias("n_sales"))


def inventory_series(project_rows: DataFrame) -> DataFrame:
    """Sold and available units per project, the series of a stacked bar."""
    return project_rows.select("project", "sold", "available")


def kpi_snapshot(units: DataFrame, sales: DataFrame, projects: DataFrame) -> DataFrame:
    """All figures as one nested row. The nested lists are as long as the project and type lists.

    The columns the figures need are written once and read by each of them.
    """
    units = stored(units.select("unit_id", "project_id", "unit_type", "status", "area_sqm"))
    sales = stored(sales.select("unit_id", "sale_date", "sale_price_sar", "discount_pct", "payment_method"))

    def one_row(df):
        return df.select(F.struct(*df.columns)).scalar()

    def listed(df, order, *cols):
        entries = F.sort_array(F.collect_list(F.struct(*order, F.struct(*cols).alias("_row"))))
        return df.agg(F.transform(entries, lambda e: e["_row"])).scalar()

    projects_now = by_project(units, sales, projects)
    types_now = by_unit_type(sales, units)
    mix = financing_mix(sales).filter(F.col("payment_method").isNotNull())
    return sales_totals(sales).select(
        "as_of",
        one_row(status_totals(units)).alias("units"),
        "revenue_sar_total",
        one_row(momentum(sales)).alias("last_3_months"),
        "avg_discount_pct",
        listed(
            projects_now, [(-F.col("sold")).alias("_o"), F.col("project").alias("_p")], *projects_now.columns
        ).alias("by_project"),
        listed(
            types_now, [(-F.col("units_sold")).alias("_o"), F.col("unit_type").alias("_p")], *types_now.columns
        ).alias("by_unit_type"),
        mix.agg(F.map_from_entries(F.collect_list(F.struct("payment_method", "n_sales")))).scalar().alias("financing_mix"),
    )


def quarterly_median_ppsqm(features: DataFrame) -> DataFrame:
    """Median achieved price per sqm by quarter and project name, in long form."""
    priced = features.select(
        quarter_start("sale_date").alias("quarter"),
        "project_name",
        F.try_divide("sale_price_sar", "area_sqm").alias("ppsqm"),
    )
    return grouped_median(priced, ["quarter", "project_name"], "ppsqm", "median_ppsqm")


def pivot_quarters(medians: DataFrame, projects: list[str]) -> DataFrame:
    """Wide form for display; the caller names the columns."""
    return medians.groupBy("quarter").pivot("project_name", projects).agg(F.first("median_ppsqm")).orderBy("quarter")


def unit_stats(units: DataFrame) -> DataFrame:
    """Counts and area and price ranges per project and unit type, and per project (null type), in one pass."""
    stats = [
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(F.col("status") == "available").alias("available"),
        F.min("area_sqm").alias("min_area"),
        F.max("area_sqm").alias("max_area"),
        F.min("list_price_sar").alias("min_price"),
        F.max("list_price_sar").alias("max_price"),
    ]
    keyed = units.groupBy("project_id", "unit_type").agg(*stats)
    # The project level is an aggregate of the few type rows, not of the units again.
    return keyed.groupingSets([["project_id", "unit_type"], ["project_id"]], "project_id", "unit_type").agg(
        F.sum("n_units").alias("n_units"),
        F.sum("available").alias("available"),
        F.min("min_area").alias("min_area"),
        F.max("max_area").alias("max_area"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.grouping("unit_type").cast("int").alias("is_project_total"),
    )


def remaining_units(units: DataFrame) -> DataFrame:
    """Available units per project; reserved ones do not count."""
    return units.groupBy("project_id").agg(F.count_if(F.col("status") == "available").alias("remaining_units"))


def sales_export(sales: DataFrame, units: DataFrame, projects: DataFrame) -> DataFrame:
    """The denormalised sales table: sale, its unit and the project of the sale."""
    u = units.select(
        "unit_id", "unit_no", "unit_type", "bedrooms", "bathrooms", "area_sqm", "floor", "view", "parking_spaces",
        "list_price_sar",
    )
    p = projects.select("project_id", F.col("name_en").alias("project_name"), F.col("city_en").alias("city"))
    return sales.join(u, "unit_id").join(p, "project_id").select(
        "sale_id", "sale_date", "sale_price_sar", "discount_pct", "payment_method", "bank_name", "buyer_city",
        "unit_id", "unit_no", "unit_type", "bedrooms", "bathrooms", "area_sqm", "floor", "view", "parking_spaces",
        "list_price_sar", "project_id", "project_name", "city",
    )
