"""Boosted regression trees fitted on rows as arrays: the trees that Spark's ``GBTRegressor`` grows.

Spark holds a row as an object and walks it through the tree for each level.
Here a task holds the bins of many rows as bytes, one array for each feature, and
a level is a few tallies over them; the driver gets the tallies of a task, never
rows. Bins, gains, limits and the choice among equal splits are Spark's, for squared
error, all rows, all features and weights of one; the result is a Spark model.
"""

import json
import sys

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame, functions as F

from darwise.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

BLOCK = 65_536  # rows whose bins stand in one array
FRESH = 40  # trees after which predictions are made from all trees anew, so that their lineage stays short
_EPS = 2.220446049250313e-16  # a child of less variance is not split
_NODE = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
    "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def split_points(distinct: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Bounds between the sorted values of a feature, ``most`` at most: all of them, or about equally many rows between two."""
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) <= most:
        return middles
    reached, out = np.cumsum(counts), []
    stride = target = reached[-1] / (most + 1)
    for i in range(1, len(distinct)):
        if abs(reached[i - 1] - target) < abs(reached[i] - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def _binned(x: np.ndarray, points: list) -> np.ndarray:
    """Bins of rows given as columns; a category is its own bin."""
    wide = max([256, *(len(p) + 1 if isinstance(p, np.ndarray) else p for p in points)])
    out = np.empty(x.shape, np.uint8 if wide == 256 else np.uint16 if wide <= 65_536 else np.uint32)
    for i, p in enumerate(points):
        out[i] = np.searchsorted(p, x[i]) if isinstance(p, np.ndarray) else x[i]
    return out


def _blocks(df: DataFrame, points: list, label: str):
    """``(bins, labels)`` of some rows each, as an RDD."""

    def block(flat, y):
        x, y = np.concatenate(flat).reshape(-1, len(points)).T, np.concatenate(y)
        if not np.isfinite(x).all() or np.isnan(y).any():
            raise ValueError("features must be finite, and labels must not be null or NaN")
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (_binned(x, points), y)], names=["bins", "y"])

    def run(batches):
        flat, y, held = [], [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, BLOCK - held), batch.slice(BLOCK - held)
                flat.append(part.column(0).flatten().to_numpy(zero_copy_only=False))
                y.append(part.column(1).to_numpy(zero_copy_only=False))
                held += part.num_rows
                if held == BLOCK:
                    yield block(flat, y)
                    flat, y, held = [], [], 0
        if held:
            yield block(flat, y)

    kind = _binned(np.zeros((len(points), 0)), points).dtype

    def arrays(row):
        y = np.frombuffer(bytes(row["y"]))
        return np.frombuffer(bytes(row["bins"]), kind).reshape(len(points), len(y)), y

    return _one_by_one(df.select("_x", label).mapInArrow(run, "bins binary, y binary").rdd.map(arrays))


def _one_by_one(rdd):
    # RDDs of one batch size meet (zip) without being written anew.
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _placed(bins: np.ndarray, levels: list) -> np.ndarray:
    """The node of the last level that each row comes to. A level is ``(node, feature, last bin or which bins go left)`` of its splits; a leaf goes left."""
    at = np.zeros(bins.shape[1], np.uint8 if len(levels) < 8 else np.int64)
    for splits in levels:
        right = np.zeros_like(at)
        for node, feature, left in splits:
            goes = bins[feature] > left if isinstance(left, int) else ~left[bins[feature]]
            right |= (goes & (at == node)).view(np.uint8) if len(levels) < 8 else (goes & (at == node)).astype(at.dtype)
        at = 2 * at + right
    return at


def _tallies(bins: np.ndarray, r: np.ndarray, levels: list, widths: list[int]) -> np.ndarray:
    """Number, sum and sum of squares of ``r`` by node, feature and bin."""
    nodes, squares, at = 1 << len(levels), r * r, _placed(bins, levels).astype(np.intp)
    out, start, key = np.empty((3, nodes, sum(widths))), 0, np.empty(len(r), np.intp)
    for feature, width in enumerate(widths):
        np.add(at * width, bins[feature], out=key)
        for i, weights in enumerate((None, r, squares)):
            out[i, :, start : start + width] = np.bincount(key, weights, nodes * width).reshape(nodes, width)
        start += width
    return out


def _variance(n, total, squares):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (squares - total * total / n) / n)


def best_splits(tally: np.ndarray, widths: list[int], categories: list[int], least: int, impurity: np.ndarray | None):
    """For each node the split of most gain, ``(gain, feature, last bin or left bins, left and right tallies)``; the first of equals.

    ``impurity`` of the nodes is known but at the root. A gain of minus infinity stands for no split.
    """
    nodes, best, start = tally.shape[1], [(-np.inf,)] * tally.shape[1], 0
    for feature, (width, kinds) in enumerate(zip(widths, categories)):
        own = tally[:, :, start : start + width]
        start += width
        if width < 2:
            continue
        order = None
        if kinds:  # categories go by their means, those without rows last
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = np.where(own[0] == 0, np.finfo(float).max, own[1] / own[0])
            order = np.argsort(mean, axis=1, kind="stable")
            own = np.take_along_axis(own, order[None], axis=2)
        left = np.cumsum(own, axis=2)
        whole, left = left[:, :, -1:], left[:, :, :-1]
        right = whole - left
        n = left[0] + right[0]
        if impurity is None:
            impurity = _variance(*(left + right)[:, :, 0])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = impurity[:, None] - left[0] / n * _variance(*left) - right[0] / n * _variance(*right)
        gain[(left[0] < least) | (right[0] < least) | ~(gain >= 0)] = -np.inf
        chosen = np.argmax(gain, axis=1)
        for node in range(nodes):
            at = int(chosen[node])
            if gain[node, at] > best[node][0]:
                goes = at
                if kinds:
                    goes = np.zeros(width, bool)
                    goes[order[node, : at + 1]] = True
                best[node] = (gain[node, at], feature, goes, left[:, node, at], right[:, node, at])
    return best


def grow(tallies, widths: list[int], categories: list[int], depth: int, least: int):
    """``(levels, values, root)`` of one tree: its splits level by level, the value at each place of the last level, and its nodes.

    ``tallies(levels)`` are the figures by node of the next level. A node is
    ``[figures, impurity, split, left, right]``.
    """
    levels: list = []
    root: list = [None, None, None, None, None]
    growing = {0: root}
    while growing and len(levels) < depth:
        tally = tallies(levels)
        impurity = None if not levels else np.array([growing[i][1] if i in growing else 0.0 for i in range(tally.shape[1])])
        if not levels:
            whole = tally[:, 0, : widths[0]].sum(axis=1)
            root[:2] = whole, float(_variance(*whole))
        found, splits, after = best_splits(tally, widths, categories, least, impurity), [], {}
        for at, node in growing.items():
            gain, *split = found[at]
            if not gain > 0:
                continue
            feature, goes, *sides = split
            splits.append((at, feature, goes))
            node[2] = float(gain), feature, goes
            for side, figures in enumerate(sides):
                child = [figures, float(_variance(*figures)), None, None, None]
                node[3 + side] = child
                if abs(child[1]) >= _EPS:
                    after[2 * at + side] = child
        if not splits:
            break
        levels, growing = [*levels, splits], after
    values = np.zeros(1 << len(levels))

    def settle(node, at, level):
        if node[2] is None:
            values[at << (len(levels) - level)] = node[0][1] / node[0][0]
        else:
            settle(node[3], 2 * at, level + 1)
            settle(node[4], 2 * at + 1, level + 1)

    settle(root, 0, 0)
    return levels, values, root


def _nodes(tree: int, root: list, points: list) -> list:
    """The nodes of a tree as rows of a stored model; two leaves of one value are one."""
    out: list = []

    def merged(node):
        if node[2] is not None:
            node = [*node[:3], merged(node[3]), merged(node[4])]
            if node[3][2] is None and node[4][2] is None and _mean(node[3]) == _mean(node[4]):
                node = [*node[:2], None, None, None]
        return node

    def put(node):
        at = len(out)
        out.append(None)
        kids, gain, split = (-1, -1), -1.0, (-1, [], -1)
        if node[2] is not None:
            gain, feature, goes = node[2]
            split = (feature, [float(points[feature][goes])], -1) if isinstance(goes, int) else (feature, [float(c) for c in np.flatnonzero(goes)], len(goes))
            kids = put(node[3]), put(node[4])
        out[at] = (tree, (at, _mean(node), node[1], [float(x) for x in node[0]], int(node[0][0]), gain, *kids, split))
        return at

    put(merged(root))
    return out


def _mean(node) -> float:
    return float(node[0][1] / node[0][0])


def _as_model(regressor: GBTRegressor, spark, trees: list, weights: list[float], features: int) -> GBTRegressionModel:
    """Trees as a model of Spark's, by way of its stored form; what that says besides the trees is a small model's of the same parameters."""
    label, column = regressor.getLabelCol(), regressor.getFeaturesCol()
    tiny = spark.createDataFrame([(0.0, Vectors.dense([0.0] * features))] * 2, [label, column])
    small, path = scratch_path(spark, "boosted"), scratch_path(spark, "boosted")
    regressor.copy({regressor.maxIter: 1}).fit(tiny).write().save(small)
    said = json.loads(spark.read.text(f"{small}/metadata").first()[0])
    said["paramMap"]["maxIter"], said["numTrees"] = regressor.getMaxIter(), len(trees)
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    of_tree = spark.read.parquet(f"{small}/treesMetadata").first()[1]
    about = [(i, json.dumps(json.loads(of_tree) | {"uid": f"{said['uid']}_{i}"}), w) for i, w in enumerate(weights)]
    spark.createDataFrame(about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([node for tree in trees for node in tree], _NODE).coalesce(1).write.parquet(f"{path}/data")
    return GBTRegressionModel.load(path)


def fit(regressor: GBTRegressor, df: DataFrame, rows: int, categories: list[int]) -> GBTRegressionModel:
    """The model that ``regressor`` fits on ``df``, whose column ``_x`` holds the ``categories`` (0: a number) as an array.

    ``df`` has ``rows`` rows in as many partitions as tasks go over them.
    """
    spark, label = df.sparkSession, regressor.getLabelCol()
    if not rows:
        raise ValueError("no rows to fit on")
    most = min(regressor.getMaxBins(), rows)
    # Bounds of numbers come from about as many rows as Spark looks at for them; from all, if there are no more.
    looked, numbers = max(most * most, 10_000), [i for i, kinds in enumerate(categories) if kinds < 2]
    seen = df if looked >= rows else df.sample(looked / rows, seed=regressor.getSeed())
    values = seen.select(F.posexplode(F.array(*[F.col("_x")[i] for i in numbers]))).groupBy("pos", "col").count().orderBy("pos", "col").toPandas()
    points: list = [*categories]
    for k, i in enumerate(numbers):
        own = values[values["pos"] == k]
        points[i] = split_points(own["col"].to_numpy(), own["count"].to_numpy(), most - 1)
    widths = [len(p) + 1 if isinstance(p, np.ndarray) else p for p in points]
    kinds = [0 if i in numbers else n for i, n in enumerate(categories)]
    least, depth, step, trees = regressor.getMinInstancesPerNode(), regressor.getMaxDepth(), regressor.getStepSize(), regressor.getMaxIter()

    def plus(bins, p, more):
        for weight, levels, leaves in more:
            p = p + weight * leaves[_placed(bins, levels)]
        return p

    def tallied(rdd, first):
        def by_node(levels):
            def tally(parts):
                out = np.zeros((3, 1 << len(levels), sum(widths)))
                for part in parts:
                    bins, r = part if first else (part[0][0], 2.0 * (part[0][1] - part[1]))
                    out += _tallies(bins, r, levels, widths)
                yield out

            return sum(rdd.mapPartitions(tally).collect())

        return by_node

    def all_trees(parts):
        held = list(parts)
        p = [np.zeros(len(y)) for _, y in held]
        for i in range(trees):
            rs = [2.0 * (y - own) if i else y for (_, y), own in zip(held, p)]
            made = grow(lambda levels: sum(_tallies(bins, r, levels, widths) for (bins, _), r in zip(held, rs)), widths, kinds, depth, least)
            yield made
            p = [plus(bins, own, [(step if i else 1.0, *made[:2])]) for (bins, _), own in zip(held, p)]

    blocks = _blocks(df, points, label)
    if blocks.getNumPartitions() == 1:  # the one task that has all rows need not ask the driver between two levels
        grown = blocks.mapPartitions(all_trees).collect()
        nodes = [_nodes(i, root, points) for i, (_, _, root) in enumerate(grown)]
        return _as_model(regressor, spark, nodes, [step if i else 1.0 for i in range(len(grown))], len(categories))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    made, nodes, predicted, before = [], [], None, None
    try:
        for i in range(trees):
            if i:
                if i % FRESH == 1:
                    after = blocks.map(lambda block, more=list(made): plus(block[0], np.zeros(len(block[1])), more))
                else:
                    after = blocks.zip(predicted).map(lambda pair, more=made[-1:]: plus(pair[0][0], pair[1], more))
                before, predicted = predicted, _one_by_one(after).persist(StorageLevel.MEMORY_AND_DISK)
            levels, leaves, root = grow(tallied(blocks.zip(predicted) if i else blocks, not i), widths, kinds, depth, least)
            made.append((step if i else 1.0, levels, leaves))
            nodes.append(_nodes(i, root, points))
            if before is not None:
                before.unpersist()
    finally:
        for rdd in (blocks, predicted, before):
            if rdd is not None:
                rdd.unpersist()
    return _as_model(regressor, spark, nodes, [weight for weight, _, _ in made], len(categories))
