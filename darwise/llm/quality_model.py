"""Operator 5, a quality classifier on random Fourier features.

A text becomes a dozen figures (lengths, shares, repetition). Random cosines of
them approximate a Gaussian kernel. Every partition of the labelled rows sums
its part of the normal equations, the driver solves for the ridge weights, and
isotonic regression over the binned scores makes them probabilities.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from darwise.llm.exchange import saved
from darwise.llm.statistics import statistics
from darwise.llm.tables import with_columns
from darwise.llm.text import filled, slices

COSINES, WIDTH, RIDGE, SEED = 256, 2.5, 1.0, 5
BINS = 2000  # of raw scores between -0.5 and 1.5, for the calibration
SUMS = 16  # partial sums of the normal equations that reach the driver
FAR = 4.0  # standard deviations at which figures end
FIGURES = 13
ADDED = (T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()))


def figures(part) -> np.ndarray:
    """The figures of each row of a slice, shares by the words, letters or lines there are."""
    s = {k: v.astype(float) for k, v in statistics(part).items()}
    words, letters, lines = (np.maximum(s[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    mean = s["word_chars"] / words
    return np.column_stack(
        [
            np.log1p(s["n_words"]), mean, np.sqrt(np.maximum(s["square_chars"] / words - mean**2, 0)), np.sqrt(s["n_symbols"] / letters),
            np.sqrt(s["n_upper"] / letters), np.sqrt(s["n_digits"] / letters), np.sqrt(s["n_marks"] / letters), s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words, s["n_distinct_words"] / np.sqrt(words), s["n_distinct_words"] / words, np.sqrt(s["same_pairs"]) / words,
            np.log1p(words / lines),
        ]
    )


def with_figures(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``_x`` in place of ``text``."""
    kept = T.StructType([f for f in docs.schema.fields if f.name != "text"])
    schema = with_columns(kept, T.StructField("_x", T.ArrayType(T.DoubleType())))

    def run(batches):
        for batch in filled(batches):
            x = np.concatenate([figures(part) for part in slices(batch.column("text"))])
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FIGURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([made if f.name == "_x" else batch.column(f.name) for f in schema.fields], names=schema.names)

    return docs.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FIGURES)


class Model:
    def __init__(self, centre, scale):
        rng = np.random.default_rng(SEED)
        self.centre, self.scale = np.array(centre), np.where(np.array(scale) > 0, scale, 1.0)
        self.slopes, self.phases = rng.normal(0, 1 / WIDTH, (FIGURES, COSINES)), rng.uniform(0, 2 * np.pi, COSINES)
        self.weights, self.knots, self.levels = np.zeros(COSINES + 1), np.array([0.0]), np.array([1.0])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -FAR, FAR)
        return np.column_stack([np.sqrt(2 / COSINES) * np.cos(z @ self.slopes + self.phases), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: ends of the pooled runs and their level."""
    runs: list[list[float]] = []  # sum, weight, first x, last x
    for a, b, c in zip(x, y, n):
        runs.append([b, c, a, a])
        while len(runs) > 1 and runs[-2][0] * runs[-1][1] >= runs[-1][0] * runs[-2][1]:
            s, w, _, last = runs.pop()
            runs[-1] = [runs[-1][0] + s, runs[-1][1] + w, runs[-1][2], last]
    knots = [k for r in runs for k in ((r[2], r[3]) if r[2] < r[3] else (r[2],))]
    levels = [r[0] / r[1] for r in runs for _ in range(2 if r[2] < r[3] else 1)]
    return np.array(knots), np.array(levels)


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learn from all labelled rows of ``with_figures(docs)``.

    ``labels`` needs ``doc_id`` and the label (0, 1; nulls are left out; of
    several the lowest counts). Without labels every score is 1.
    """
    one = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("_y"))
    rows = saved(measured.sparkSession, measured.select("doc_id", "_x").join(one, "doc_id").select("_x", "_y"), "labelled")
    moments = rows.agg(F.count(F.lit(1)), *(f(F.col("_x")[i]) for f in (F.avg, F.stddev_pop) for i in range(FIGURES))).first()
    if not moments[0]:
        return Model(np.zeros(FIGURES), np.ones(FIGURES))
    model = Model(moments[1 : FIGURES + 1], moments[FIGURES + 1 :])
    d = COSINES + 1

    def normal(batches):
        total = np.zeros((d, d + 1))
        for batch in filled(batches):
            f = model.features(_matrix(batch.column("_x")))
            total[:, :d] += f.T @ f
            total[:, d] += f.T @ batch.column("_y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    def add(table):
        total = np.zeros(d * (d + 1))
        for s in table["sums"]:
            total += np.frombuffer(s.as_buffer())
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(normal, "part int, sums binary").groupBy("part").applyInArrow(add, "sums binary").collect()
    total = sum(np.frombuffer(r.sums).reshape(d, d + 1) for r in sums)
    ridge = RIDGE * np.eye(d)
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, :d] + ridge, total[:, d])

    def binned(batches):
        for batch in filled(batches):
            at = np.clip((model.raw(_matrix(batch.column("_x"))) + 0.5) / 2, 0, 1) * BINS
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.round(at).astype(np.int32)), "y": batch.column("_y")})

    bins = rows.mapInArrow(binned, "bin int, y int").groupBy("bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(np.array([r.bin / BINS * 2 - 0.5 for r in bins]), np.array([float(r.y) for r in bins]), np.array([float(r.n) for r in bins]))
    return model


def _verdict(model: Model, x: np.ndarray) -> dict[str, pa.Array]:
    p = np.clip(model.score(x), 0, 1)
    return {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}


def score(measured: DataFrame, model: Model) -> DataFrame:
    """Replace ``_x`` by ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts have the figures of no words and are scored like any
    other; only the text is looked at; input columns named like an added one
    give way.
    """
    schema = with_columns(T.StructType([f for f in measured.schema.fields if f.name != "_x"]), *ADDED)

    def run(batches):
        for batch in filled(batches):
            made = _verdict(model, _matrix(batch.column("_x")))
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema.fields], names=schema.names)

    return measured.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, figures and score in one pass over the texts."""
    schema = with_columns(docs.schema, *ADDED)

    def run(batches):
        for batch in filled(batches):
            made = _verdict(model, np.concatenate([figures(part) for part in slices(batch.column("text"))]))
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema.fields], names=schema.names)

    return docs.mapInArrow(run, schema)
