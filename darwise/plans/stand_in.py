"""The sales model over order tables: one unit per order, sold when the order is final."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units_with_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with what their order lines add up to; the first line names the part.

    The sums combine before the shuffle, and the columns a query does not use
    are pruned from all five scans.
    """
    line = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("l_partkey"),
            F.count(F.lit(1)).cast("int").alias("n_lines"),
            F.sum("l_quantity").alias("quantity"),
            F.max("l_shipdate").alias("shipped"),
            F.sum("l_extendedprice").alias("gross"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        )
    )
    return (
        table(spark, sf_dir, "orders")
        .join(line, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )


def _status():
    return F.when(F.col("o_orderstatus") == "F", "sold").when(F.col("o_orderstatus") == "O", "available").otherwise("reserved")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units_with_line(spark, sf_dir).select(
        F.col("o_orderkey").alias("unit_id"),
        F.col("n_nationkey").alias("project_id"),
        F.concat(F.col("n_name"), F.lit("-"), F.col("o_orderkey")).alias("unit_no"),
        F.col("p_type").alias("unit_type"),
        F.col("n_lines").alias("bedrooms"),
        F.col("quantity").cast("int").alias("bathrooms"),
        F.col("p_size").cast("double").alias("area_sqm"),
        F.when(F.col("p_size") > 10, F.col("n_lines")).alias("floor"),
        F.col("p_brand").alias("view"),
        F.col("n_lines").alias("parking_spaces"),
        F.col("o_totalprice").alias("list_price_sar"),
        _status().alias("status"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = units_with_line(spark, sf_dir).filter(F.col("o_orderstatus") == "F")
    return sold.select(
        F.col("o_orderkey").alias("sale_id"),
        F.col("o_orderkey").alias("unit_id"),
        F.col("n_nationkey").alias("project_id"),
        F.col("shipped").cast("date").alias("sale_date"),
        F.col("net").alias("sale_price_sar"),
        (100 * (1 - F.try_divide("net", "gross"))).alias("discount_pct"),
        F.col("o_orderpriority").alias("payment_method"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("c_mktsegment")).alias("bank_name"),
        F.col("n_name").alias("buyer_city"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per nation, launched a few months apart from 1995 on."""
    counts = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("total_units"))
    )
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select(
            F.col("n_nationkey").alias("project_id"),
            F.col("n_name").alias("name_en"),
            F.col("r_name").alias("city_en"),
            F.format_string("1995-%02d", F.col("n_nationkey") % 12 + 1).alias("launch_month"),
            F.coalesce("total_units", F.lit(0)).alias("total_units"),
        )
    )


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return units(spark, sf_dir), sales(spark, sf_dir), projects(spark, sf_dir)
