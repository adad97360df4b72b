"""Operator 11, whitening of embeddings with distributed block matrices.

The distinct vectors are numbered and packed into blocks of rows. Scatter and
projection are products of MLlib's BlockMatrix over the centred blocks; only
the eigenvectors of one small square matrix are found on the driver.

A tall matrix of one column of blocks would leave a product to a few tasks, or
to one. So blocks are folded into a square: for the scatter block ``k`` stands
in column ``g`` of the left and ``h`` of the right factor, (g, h) being one of
as many cells as there are partitions, and the cells of the product are sums
over their own blocks; for the projection blocks fill a square grid, which is
multiplied by the whitening matrix repeated along a diagonal.
"""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, functions as F, types as T

from darwise.llm.exchange import saved
from darwise.llm.tables import partitions
from darwise.llm.text import filled

BLOCK_BYTES = 1 << 20  # of centred doubles in a block, up to MOST_BLOCKS blocks; beyond that blocks grow
MOST_BLOCKS = 100_000  # the driver holds the place of each block
SCHEMA = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def fixed_point(df: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)``: entries as whole numbers ``floor(scale * entry)``, rows with missing or non-finite entries left out."""
    v = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = v.where(F.col("v").isNotNull()).where(sound & (F.size("v") > 0))
    return v.select("_id", F.transform("v", lambda c: F.floor(c * float(scale))).alias("x"))


def packed(rows: DataFrame, rows_per_block: int) -> DataFrame:
    """The distinct vectors in blocks: ``part, k, rows, data`` with whole numbers of the least width as bytes."""
    one = rows.groupBy("x").agg(F.count(F.lit(1)).alias("_n")).select("x")

    def pack(batches):
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(take):
            nonlocal k, held, size
            x = np.concatenate(held)
            held, size = ([x[take:]], len(x) - take) if len(x) > take else ([], 0)
            x, k = x[:take], k + 1
            kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k - 1], pa.int32()), "rows": pa.array([len(x)], pa.int32()), "data": pa.array([x.astype(kind).tobytes()], pa.binary())})

        for batch in filled(batches):
            column = batch.column("x")
            held.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))
            size += len(column)
            while size >= rows_per_block:
                yield block(rows_per_block)
        if size:
            yield block(size)

    return one.mapInArrow(pack, "part int, k int, rows int, data binary")


def opened(data: bytes, rows: int, d: int) -> np.ndarray:
    """The whole numbers of a block."""
    return np.frombuffer(data, f"<i{len(data) // (rows * d)}").astype(np.int64).reshape(rows, d)


class Moments:
    """Number and exact sums of the distinct vectors."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums, self.largest = n, sums, largest
        self.mean = np.array([float(Fraction(s, n)) for s in sums])
        reach = n * largest + max(map(abs, sums))
        self.narrow = reach * reach * len(sums) < 2**63  # 64 bits hold every square sum

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - np.array(self.sums)) / self.n if self.narrow else x - self.mean

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over the entries of ``(n * x - sum) ** 2``, null beyond 38 digits."""
        kind = pa.decimal128(38, 0)
        if self.narrow:
            return pa.array(((self.n * x - np.array(self.sums)) ** 2).sum(axis=1)).cast(kind)
        from decimal import Decimal

        found = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return pa.array([Decimal(f) if f < 10**38 else None for f in found], kind)


def moments(blocks: DataFrame, d: int) -> Moments:
    def add(batches):
        n, high, low, largest = 0, np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in filled(batches):
            for data, rows in zip(batch.column("data").to_pylist(), batch.column("rows").to_pylist()):
                x = opened(data, rows, d)
                n, largest = n + rows, max(largest, int(x.max()), -int(x.min()))
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "high": [high.tolist()], "low": [low.tolist()], "largest": pa.array([str(largest)])})

    # One row per task.
    found = blocks.select("rows", "data").mapInArrow(add, "n long, high array<long>, low array<long>, largest string").collect()
    sums = [sum((r.high[i] << 32) + r.low[i] for r in found) for i in range(d)]
    return Moments(sum(r.n for r in found), sums, max(int(r.largest) for r in found))


def matrix(blocks: DataFrame, held: Moments, rows_per_block: int, row_of, column_of, columns: int, height: int) -> BlockMatrix:
    """The centred blocks as a BlockMatrix, block ``number`` at ``(row_of, column_of)``; short blocks end in zero rows."""
    d = len(held.sums)
    place = T.StructType([T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])
    cell = MatrixUDT.sqlType()

    def centred(batches):
        for batch in filled(batches):
            # One block at a time, as doubles are wider than what is stored.
            for number, n, data in zip(*(batch.column(c) for c in ("number", "rows", "data"))):
                x = np.zeros((rows_per_block, d))
                x[: n.as_py()] = held.centred(opened(data.as_py(), n.as_py(), d))
                at = {"row": row_of(number.as_py()), "column": column_of(number.as_py())}
                values = pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel()))
                none = pa.array([None], pa.list_(pa.int32()))
                parts = [pa.array([1], pa.int8()), pa.array([rows_per_block], pa.int32()), pa.array([d], pa.int32()), none, none, values, pa.array([True])]
                yield pa.RecordBatch.from_pydict({"place": pa.array([at], pa.struct([("row", pa.int64()), ("column", pa.int64())])), "cell": pa.StructArray.from_arrays(parts, names=cell.names)})

    found = blocks.select("number", "rows", "data").mapInArrow(centred, T.StructType([T.StructField("place", place), T.StructField("cell", MatrixUDT())]))
    # The way of the Python constructor, but for its conversion of an RDD number by number.
    made = callMLlibFunc("createBlockMatrix", found, rows_per_block, d, height * rows_per_block, columns * d)
    return BlockMatrix(made, rows_per_block, d)


def scatter(blocks: DataFrame, held: Moments, rows_per_block: int, count: int) -> np.ndarray:
    """Sum of the outer products of the centred vectors, by one transposed product."""
    q = max(1, min(math.isqrt(count), math.isqrt(partitions(blocks))))
    left = matrix(blocks, held, rows_per_block, lambda k: k, lambda k: k % (q * q) // q, q, count)
    right = matrix(blocks, held, rows_per_block, lambda k: k, lambda k: k % q, q, count)
    cells = left.transpose().multiply(right).blocks
    return cells.map(lambda cell: cell[1].toArray()).treeReduce(np.add)


def projected(blocks: DataFrame, held: Moments, rows_per_block: int, count: int, whitening: np.ndarray) -> DataFrame:
    """``number, w``: for each block its centred vectors times the whitening matrix, row by row as doubles."""
    spark, (d, k), c = blocks.sparkSession, whitening.shape, math.isqrt(count - 1) + 1
    grid = matrix(blocks, held, rows_per_block, lambda n: n // c, lambda n: n % c, c, -(-count // c))
    small = DenseMatrix(d, k, whitening.ravel(), True)
    repeated = spark.sparkContext.parallelize(range(c), min(c, partitions(blocks))).map(lambda j: ((j, j), small))
    product = grid.multiply(BlockMatrix(repeated, d, k, c * d, c * k))
    found = product.blocks.map(lambda cell: (cell[0][0] * c + cell[0][1], bytearray(np.ascontiguousarray(cell[1].toArray()).tobytes())))
    return spark.createDataFrame(found, "number long, w binary")


def whiten(embeddings: DataFrame, scale: float = 256, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every sound row in principal components of unit variance, ``components`` rows for each.

    Returns the id and ``component`` (from 1, by falling variance), ``n``
    (distinct vectors), ``deviation`` (exact), ``whitened``, ``explained`` (share
    of the variance) and ``identity_error`` (largest difference between the
    covariance of ``whitened`` over the distinct vectors and the identity).

    Entries become whole numbers ``floor(scale * entry)``, ends of the 64-bit
    range at most. Rows without a vector, with an empty one or with null or
    non-finite entries are left out; so are those of another length than most
    (of equally frequent lengths the longest counts). Mean and covariance are
    over the distinct vectors, each once, however often it is repeated; repeated
    rows and null ids are rows like any other. There are no more components than
    entries; one without variance has ``whitened`` and ``explained`` 0 and no
    part in the error. An empty table gives an empty one; other columns are not
    looked at.
    """
    spark = embeddings.sparkSession
    rows = fixed_point(embeddings, scale, id_col, vector_col)
    size = F.size("x").alias("d")
    lengths = rows.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = f"`{id_col}` {embeddings.schema[id_col].dataType.simpleString()}, {SCHEMA}"
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = rows.where(F.size("x") == d)
    rows_per_block = max(1, max(block_bytes // (8 * d), -(-lengths["n"] // MOST_BLOCKS)))
    blocks = saved(spark, packed(rows, rows_per_block), "blocks")
    # Numbers of blocks follow from how many each task made, one row per task.
    made = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    first = np.concatenate([[0], np.cumsum([n for _, n in made])]).tolist()
    bases = spark.createDataFrame([(part, base) for (part, _), base in zip(made, first)], "part int, base long")
    blocks, count = blocks.join(bases, "part").select((F.col("base") + F.col("k")).alias("number"), "rows", "data"), first[-1]

    held = moments(blocks, d)
    covariance = scatter(blocks, held, rows_per_block, count) / held.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    k = min(components, d)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total, least = float(np.trace(covariance)), max(1.0, float(abs(values[0]))) * d * np.finfo(float).eps
    real = values > least
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    whitening = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    explained = [float(v) / total if r else 0.0 for v, r in zip(values, real)]

    met = saved(spark, blocks.join(projected(blocks, held, rows_per_block, count, whitening), "number"), "projected")

    def unpack(batches):
        for batch in filled(batches):
            for data, n, w in zip(*(batch.column(c).to_pylist() for c in ("data", "rows", "w"))):
                x, w = opened(data, n, d), np.frombuffer(w).reshape(-1, k)[:n]
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
                yield pa.RecordBatch.from_pydict({"x": lists(x), "deviation": held.deviation(x), "w": lists(w)})

    fit = met.mapInArrow(unpack, "x array<long>, deviation decimal(38,0), w array<double>")
    w = [F.col("w")[i] for i in range(k)]
    chosen = [i for i in range(k) if real[i]]
    sums = fit.agg(*(F.avg(w[i]) for i in chosen), *(F.avg(w[i] * w[j]) for i in chosen for j in chosen)).first() if chosen else ()
    m = len(chosen)
    means, products = np.array(sums[:m], float), np.array(sums[m:], float).reshape(m, m)
    error = float(np.abs(products - np.outer(means, means) - np.eye(m)).max()) if m else 0.0
    out = rows.join(fit, "x").select(
        F.col("_id").alias(id_col),
        F.lit(held.n).cast("long").alias("n"),
        "deviation",
        F.inline(F.array(*(F.struct(F.lit(i + 1).alias("component"), w[i].alias("whitened"), F.lit(explained[i]).alias("explained")) for i in range(k)))),
    )
    return out.select(id_col, "component", "n", "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
