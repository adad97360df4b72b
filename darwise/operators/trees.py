"""Boosted trees as leaves that features leave open: a block of rows is scored at a time.

A row that Spark scores walks each tree alone. Here a number is looked up once
among all bounds of its feature. By its place there a table of a tree and feature
tells, as bits, which leaves the conditions on that feature leave open; of the
leaves that all features of a tree leave open, the first is the row's. Where one
feature changes, only its own table is looked into again.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from darwise.sources.scratch import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

BLOCK = 4096  # rows that are scored at a time
_BITS = 62  # leaves of a tree that stand as bits of a number
_SMALL = np.zeros(1 << 16, np.int64)  # the place of the only bit of a number
_SMALL[1 << np.arange(16)] = np.arange(16)


def read_trees(model) -> list:
    """``(weight, features it looks at, root)`` of each tree; a node is a value, or ``(feature, bound or left categories, left, right)``."""
    spark = SparkSession.active()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes: dict = {}
    for row in spark.read.parquet(f"{path}/data").collect():  # a row for each node of the model
        nodes.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]

    def root(held, at, seen):
        node = held[at]
        if node["leftChild"] < 0:
            return float(node["prediction"])
        split = node["split"]
        feature, given, many = split["featureIndex"], split["leftCategoriesOrThreshold"], split["numCategories"]
        seen.add(feature)
        test = float(given[0]) if many < 0 else np.isin(np.arange(many), given)
        return feature, test, root(held, node["leftChild"], seen), root(held, node["rightChild"], seen)

    out = []
    for at, weight in enumerate(model.treeWeights):
        seen: set = set()
        made = root(nodes[at], 0, seen)
        out.append((float(weight), seen, made))
    return out


def tree_values(node, x: np.ndarray):
    """A tree's values for rows given as columns."""
    if isinstance(node, float):
        return node
    feature, test, left, right = node
    c = x[feature] <= test if isinstance(test, float) else test[x[feature].astype(np.int64)]
    return np.where(c, tree_values(left, x), tree_values(right, x))


def _columns(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(lists), -1).T)


def tables(trees: list, features: int) -> tuple[list, list]:
    """``(bounds, tables)``: sorted bounds of each feature (None: its numbers are categories), and ``(values, {feature: open leaves})`` of each tree.

    A tree of more leaves than a number has bits stays ``(None, (weight, root))``.
    """
    tests: list[list] = [[] for _ in range(features)]

    def collect(node):
        if not isinstance(node, float):
            tests[node[0]].append(node[1])
            collect(node[2])
            collect(node[3])

    for _, _, root in trees:
        collect(root)
    bounds = [None if any(not isinstance(t, float) for t in found) else np.unique(np.array(found, float)) for found in tests]
    width = [len(b) + 1 if b is not None else max(len(t) for t in found) for b, found in zip(bounds, tests)]

    def made(weight, root):
        values: list[float] = []
        open_leaves: dict = {}

        def number(node):
            """The leaves below a node, from the left."""
            if isinstance(node, float):
                values.append(weight * node)
                return len(values) - 1, len(values)
            feature, test, left, right = node
            first, middle = number(left)
            last = number(right)[1]
            if last <= _BITS:
                goes = np.arange(width[feature]) <= np.searchsorted(bounds[feature], test) if isinstance(test, float) else np.resize(test, width[feature])
                table = open_leaves.setdefault(feature, np.full(width[feature], -1, np.int64))
                table[~goes] &= ~(((1 << middle) - 1) ^ ((1 << first) - 1))
            return first, last

        number(root)
        if len(values) > _BITS:
            return None, (weight, root)
        return np.array(values), open_leaves

    return bounds, [made(weight, root) for weight, _, root in trees]


def _places(bounds: list, x: np.ndarray) -> np.ndarray:
    """Numbers of rows (as columns) as places among the bounds."""
    out = np.empty(x.shape, np.intp)
    for i, b in enumerate(bounds):
        out[i] = x[i] if b is None else np.searchsorted(b, x[i])
    return out


def _first_leaf(values: np.ndarray, left_open: np.ndarray) -> np.ndarray:
    """The value of the first leaf left open."""
    first = left_open & -left_open
    if len(values) <= 16:
        return values[_SMALL[first]]
    return values[np.log2(first).astype(np.intp)]


def _value(values, by_feature, places: np.ndarray, x: np.ndarray):
    if values is None:
        weight, root = by_feature
        return weight * tree_values(root, x)
    left_open = np.int64(-1)
    for feature, table in by_feature.items():
        left_open = left_open & table[places[feature]]
    return _first_leaf(values, left_open)


def with_vectors(coding: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``_x``, the numbers that the steps before the trees make."""
    return coding.transform(df).withColumn("_x", vector_to_array("_features"))


def with_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``_x``, the numbers the trees look at."""
    return with_vectors(PipelineModel(model.stages[:-1]), df)


def scored(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Add what the trees of ``model``, its last stage, give."""
    bounds, made = tables(read_trees(model.stages[-1]), model.stages[-1].numFeatures)

    def score(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        out = np.zeros(len(lists))
        for at in range(0, len(lists), BLOCK):
            x = _columns(lists.slice(at, BLOCK))
            places = _places(bounds, x)
            for values, by_feature in made:
                out[at : at + BLOCK] += _value(values, by_feature, places, x)
        return pa.array(out)

    return with_features(model, df).withColumn(name, F.arrow_udf(score, "double")("_x"))


def shuffled_errors(model: PipelineModel, values: DataFrame, features: int, repeats: int) -> DataFrame:
    """``(_v, total, n)``, several rows for each ``_v``: absolute errors of rows as they are (0) and with feature ``_v`` replaced.

    ``values`` is one column. A row is ``1 + features + features * repeats`` of
    them that follow each other in one partition: the truth, its numbers, and
    ``repeats`` that take the place of each.
    """
    trees, wide = read_trees(model.stages[-1]), 1 + features + features * repeats
    bounds, made = tables(trees, features)

    def errors(block):
        y, x, given = block[0], block[1 : features + 1], block[features + 1 :].reshape(features, repeats, -1)
        places = _places(bounds, x)
        other = [_places([b], g.reshape(1, -1)).reshape(g.shape) for b, g in zip(bounds, given)]
        held = [_value(values, by_feature, places, x) for values, by_feature in made]
        base = np.zeros(len(y))
        for own in held:
            base += own
        changed = np.repeat(base[None], features, axis=0)[:, None].repeat(repeats, axis=1)
        for before, (values, by_feature), (weight, seen, root) in zip(held, made, trees):
            if values is None:
                for feature in seen:
                    for k in range(repeats):
                        z = x.copy()
                        z[feature] = given[feature, k]
                        changed[feature, k] += weight * tree_values(root, z) - before
                continue
            left_open = {feature: table[places[feature]] for feature, table in by_feature.items()}
            for feature, table in by_feature.items():
                rest = np.int64(-1)
                for also, leaves in left_open.items():
                    if also != feature:
                        rest = rest & leaves
                changed[feature] += _first_leaf(values, table[other[feature]] & rest) - before
        sums = [np.abs(y - base).sum(), *[sum(np.abs(y - c).sum() for c in changed[f]) for f in range(features)]]
        n = np.where(np.arange(features + 1), repeats, 1) * len(y)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(features + 1), pa.int32()), pa.array(np.array(sums, float)), pa.array(n, pa.int64())], names=["_v", "total", "n"])

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting, size = [*waiting, batch.column(0).to_numpy(zero_copy_only=False)], size + batch.num_rows
            if size >= wide * BLOCK:
                flat = np.concatenate(waiting)
                full = size // wide * wide
                yield errors(np.ascontiguousarray(flat[:full].reshape(-1, wide).T))
                waiting, size = [flat[full:]], size - full
        if size:
            yield errors(np.ascontiguousarray(np.concatenate(waiting).reshape(-1, wide).T))

    return values.mapInArrow(run, "_v int, total double, n long")
