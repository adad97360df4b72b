"""Approximate nearest neighbours over clustered lists of vectors.

Every row belongs to the list of its nearest centre. A question looks only into
the few lists whose centres are nearest to it, so files of other lists are not
read. Recall against `vectors.dense_topk` is a matter of ``probes``; with all
lists probed the result is exact.
"""

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from darwise import values as V
from darwise.operators.vectors import SCORE_DIGITS, _best, _unit_rows, l2_normalize, rank_top
from darwise.sources.scratch import scratch_path, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

SAMPLE_ROWS = 50_000  # rows that the centres are fitted on, at most; every row is assigned
PART_ROWS = 20_000  # rows of a list, or questions to it, that meet in one task


class Clustered(NamedTuple):
    rows: DataFrame  # list, part, id, vector (unit length); files by list
    sizes: DataFrame  # list, rows, parts
    centres: np.ndarray  # one unit row per list


def dense(column: str, dim: int):
    """A sparse struct of `hashed_ngrams` as a dense array; arrays stay."""
    pairs = F.map_from_arrays(F.col(f"{column}.buckets"), F.col(f"{column}.weights"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(pairs, i), F.lit(0.0)))


def fit_centres(vectors: DataFrame, lists: int, vector: str = "vector", seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres of at most ``lists`` clusters of the unit vectors, fitted on the ``sample_rows`` rows of lowest hash.

    The centres come to the driver: ``lists`` times the dimension.
    """
    unit = vectors.where(F.col(vector).isNotNull()).select(l2_normalize(F.col(vector)).alias("v"))
    sample = stored(unit.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(sample_rows).select(array_to_vector("v").alias("features")))
    if not sample.limit(1).count():
        return np.zeros((0, 0))
    found = KMeans(k=lists, seed=seed, maxIter=15, initSteps=2).fit(sample).clusterCenters()
    centres = np.array(found)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def _nearest(centres: np.ndarray, dim: int, n: int, id_col: str, vector: str, named: pa.DataType):
    """For Arrow batches of ids and vectors: ``id, list, vector`` with the ``n`` lists of nearest centre of each."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit_rows(batch.column(vector), dim)
            order = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :n]
            ids = batch.column(id_col).take(pa.array(np.repeat(np.arange(len(v)), order.shape[1])))
            held = np.repeat(v, order.shape[1], axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dim, pa.int32()), pa.array(held.ravel()))
            yield pa.RecordBatch.from_arrays([ids.cast(named), pa.array(order.ravel().astype(np.int32)), lists], names=["id", "list", "vector"])

    return run


def cluster(vectors: DataFrame, lists: int, id_col: str = "chunk_id", vector: str = "vector", path: str | None = None, seed: int = 42, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS) -> Clustered:
    """Assign every row with a vector (an array; see ``dense``) to a list and write the lists, one folder each, to ``path``.

    Without a path they go to the shared folder. A list of many rows is cut into
    parts of about ``part_rows``, so that a hot one is work for many tasks.
    """
    spark, at = vectors.sparkSession, path or scratch_path(vectors.sparkSession, "lists")
    v = vectors.select(id_col, vector).where(F.col(vector).isNotNull())
    centres = fit_centres(v, lists, vector, seed, sample_rows)
    kind = v.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("list", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    if not len(centres):
        empty = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("part", T.LongType())]))
        return Clustered(empty, spark.createDataFrame([], "list int, rows long, parts long"), centres)
    assigned = stored(v.mapInArrow(_nearest(centres, centres.shape[1], 1, id_col, vector, to_arrow_type(kind)), schema))
    sizes = stored(assigned.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).withColumn("parts", F.ceil(F.col("rows") / part_rows)))
    dealt = assigned.join(F.broadcast(sizes.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    # At most `lists` rows are broadcast.
    dealt.repartition("list", "part").write.partitionBy("list").parquet(at)
    return Clustered(spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.LongType())])).parquet(at), sizes, centres)


def save_centres(spark: SparkSession, centres: np.ndarray, path: str) -> None:
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_clustered(spark: SparkSession, path: str) -> Clustered:
    """What ``store_clustered`` has written."""
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()])
    return Clustered(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/sizes"), centres)


def store_clustered(vectors: DataFrame, lists: int, path: str, **settings) -> Clustered:
    """``cluster`` with everything under ``path``, for `load_clustered`."""
    made = cluster(vectors, lists, path=f"{path}/lists", **settings)
    made.sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    save_centres(vectors.sparkSession, made.centres, f"{path}/centres")
    return made


def clustered_topk(queries: DataFrame, clustered: Clustered, k: int = V.CANDIDATES, probes: int = 8, id_col: str = "chunk_id", vector: str = "vector", part_rows: int = PART_ROWS) -> DataFrame:
    """``(query_id, <id_col>, score, dense_rank)``: the ``k`` best of the ``probes`` lists nearest to each query.

    Only files of lists that some query looks into are read. A part of a list
    meets the queries of the list in blocks of at most ``part_rows``; the pairs
    themselves never leave a task, but for the best of each.
    """
    centres, spark = clustered.centres, queries.sparkSession
    q = queries.select("query_id", vector).where(F.col(vector).isNotNull())
    kind, own = q.schema["query_id"].dataType, clustered.rows.schema["id"].dataType
    result = T.StructType([T.StructField("query_id", kind), T.StructField(id_col, own), T.StructField("score", T.DoubleType())])
    if not len(centres):
        return rank_top(spark.createDataFrame([], result), k, id_col, "dense_rank")
    dim = centres.shape[1]
    schema = T.StructType([T.StructField("id", kind), T.StructField("list", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    asked = stored(q.mapInArrow(_nearest(centres, dim, probes, "query_id", vector, to_arrow_type(kind)), schema))
    wanted = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("blocks")).join(clustered.sizes, "list")
    wanted = stored(wanted.select("list", "parts", "blocks"))
    # The numbers of the lists, at most as many as there are centres.
    lists = [r["list"] for r in wanted.select("list").collect()]
    rows = clustered.rows.where(F.col("list").isin(lists)).join(F.broadcast(wanted.select("list", "blocks")), "list")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("list", "part", "block", "id", "vector")
    asked = asked.join(F.broadcast(wanted), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("list", "part", "block", "id", "vector")

    def meet(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)
        a, b = (t.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim) for t in (left, right))
        scores = np.round(a @ b.T, SCORE_DIGITS)
        least = np.partition(scores, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(a), -np.inf)
        query, row = np.nonzero(scores >= least[:, None])
        chosen = _best(query, right.column("id").to_numpy()[row], scores[query, row], k)
        query, row = query[chosen], row[chosen]
        return pa.Table.from_arrays([left.column("id").take(pa.array(query)), right.column("id").take(pa.array(row)), pa.array(scores[query, row])], schema=arrow)

    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in result.fields])
    key = ["list", "part", "block"]
    found = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(meet, result)
    return rank_top(found, k, id_col, "dense_rank")
