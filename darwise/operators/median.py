"""Exact grouped medians, whatever the size of a group.

Equal values fold into one row with a count, the rows are written once in order
of group and value, and each middle value is found from prefix sums: of the
written parts within a group, then of the rows within a part. A group that holds
most of the rows is spread over many parts, and one path serves all sizes.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from darwise.sources.scratch import stored


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that treats null keys as equal, as grouping does."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])


def grouped_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """``keys`` and the interpolated median of ``value``; nulls do not count.

    The folded rows are written when this is called. Without ``keys`` there is
    one row, the median over all.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    folded = stored(folded.repartitionByRange(n, *keys, "_v").withColumn("_part", F.spark_partition_id()))
    known = folded.where(F.col("_v").isNotNull())
    # At most one row per part and group: small, whatever the groups' sizes.
    parts = known.groupBy("_part", *keys).agg(F.sum("_c").alias("_in_part"))
    own = W.partitionBy(*keys)
    parts = parts.withColumns({"_n": F.sum("_in_part").over(own), "_before": F.sum("_in_part").over(own.orderBy("_part")) - F.col("_in_part")})
    # Ranks of the two middle values, from 1; only parts that hold one of them are looked into.
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    parts = parts.withColumns({"_lo": lo, "_hi": hi}).where((F.col("_before") < F.col("_hi")) & (F.col("_before") + F.col("_in_part") >= F.col("_lo")))
    inside = _joined(known, parts.select("_part", *keys, "_before", "_lo", "_hi"), ["_part", *keys])
    upto = F.col("_before") + F.sum("_c").over(W.partitionBy("_part", *keys).orderBy("_v"))
    ranked = inside.withColumn("_upto", upto)

    def at(rank):
        return F.max(F.when((F.col("_upto") - F.col("_c") < F.col(rank)) & (F.col("_upto") >= F.col(rank)), F.col("_v")))

    found = ranked.groupBy(*keys).agg(((at("_lo") + at("_hi")) / 2).alias(name))
    # A group without values keeps its row.
    return _joined(folded.select(*keys).distinct(), found, keys, "left") if keys else found
