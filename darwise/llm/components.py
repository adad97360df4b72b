"""Connected components of a graph held in tables."""

from pyspark.sql import DataFrame, functions as F

from darwise.llm.exchange import saved


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``, the root being the component's smallest node.

    Large-star and small-star steps in turn: every node links its larger
    neighbours, then its smaller ones, to the smallest it knows. The edges shrink
    to stars in about the logarithm of the longest path, and each step groups
    nodes without ever holding a component in one place. Every step is written
    to the shared folder.
    """
    spark = edges.sparkSession
    small, large = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = saved(spark, edges.select(small, large).where("a < b").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        star = saved(spark, star, "links")
        # Now each node to its smallest neighbour, and so its other smaller neighbours.
        least = star.groupBy("b").agg(F.min("a").alias("m"))
        joined = star.join(least, "b")
        after = joined.select(F.col("m").alias("a"), "b").unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        after = saved(spark, after, "links")
        # Stars all through: no root is a leaf and no leaf has two roots.
        n, leaves = after.agg(F.count(F.lit(1)), F.count_distinct("b")).first()
        chained = after.join(after.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        now = after
        if n == leaves and not chained:
            roots = after.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
            return roots.unionByName(after.select(F.col("b").alias("node"), F.col("a").alias("root")))
