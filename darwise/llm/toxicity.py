"""Operator 2, toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary texts each have a spelling model with shared backoff (see
``kneser_ney_words``). A text is compared by length-normalised log-likelihoods:
of the whole text, of its most toxic word, and of its three most toxic words, as
one expression in a long text would vanish in the mean. Two figures more say how
many of its words are toxic, and what share. A logistic curve over these five,
fitted on halves of the sample scored by the other half's models, gives a score
from 0 to 1.
"""

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from darwise.llm.kneser_ney_words import Steps, fitted, ngrams
from darwise.llm.tables import with_columns
from darwise.llm.text import filled, worker_cache

ORDER = 8
MARKED = 3.0  # log ratio at which a word counts by half as toxic
SAMPLE = (3000, 1500)  # ordinary and toxic texts that the models learn from at most
KEPT_WORDS = 300_000  # words a worker remembers the ratios of
WORDS = re.compile(r"[^\W\d_]+")
ADDED = (T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()))


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _share(toxic: float, n_words: int) -> list[float]:
    """Logs of the share and of the number of toxic words, steadied for short texts."""
    return [math.log((toxic + 0.1) / (n_words + 10)), math.log(toxic + 0.1)]


class Scorer:
    """What the models say of texts, from the arrays of ``fitted``."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.model, self.ratios = Steps(arrays, ORDER), {}

    def features(self, texts: list[str | None]) -> list[list[float]]:
        every = [words(t) for t in texts]
        unseen = list({w for own in every for w in own if w not in self.ratios})
        if len(self.ratios) + len(unseen) > KEPT_WORDS:
            self.ratios = {}
            unseen = list({w for own in every for w in own})
        self.ratios.update(zip(unseen, self.model.log_ratios(unseen).tolist()))
        return [self._of(own) for own in every]

    def _of(self, own: list[str]) -> list[float]:
        if not own:
            return [0.0, 0.0, 0.0, *_share(0.0, 0)]
        values, lengths = np.array([self.ratios[w] for w in own]), np.array([len(w) + 1 for w in own])
        top = np.argpartition(values, -3)[-3:] if len(own) > 3 else np.arange(len(own))
        return [float(values.sum() / lengths.sum()), float((values / lengths).max()), float(values[top].sum() / 3 / np.sqrt(lengths[top].mean())), *_share(float((1 / (1 + np.exp(MARKED - values))).sum()), len(own))]


class Model:
    """Fitted: the steps of the class models as arrays, and the curve over the comparisons. Its size is bounded by the sample."""

    def __init__(self, arrays: dict[str, np.ndarray], centre: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.arrays, self.centre, self.scale, self.weights = arrays, centre, scale, weights

    def curve(self, x: np.ndarray) -> np.ndarray:
        z = (np.atleast_2d(x) - self.centre) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> tuple:
    """Ridge logistic regression by Newton's method; the rarer class weighs more, by the root of the ratio."""
    centre, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    share = np.where(y == 1, np.sqrt((y == 0).sum() / max(1, (y == 1).sum())), 1.0)
    w, ridge = np.zeros(z.shape[1]), penalty * np.diag([1e-6] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (share * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def sampling_shift(seen: tuple[int, int], there: tuple[int, int]) -> float:
    """What the curve's intercept gains so that scores stand for the classes as labelled, not as sampled.

    Both counts are of ordinary and toxic texts. The root weight of
    ``_logistic`` evens out half of the classes' log ratio in the sample, so half of the
    difference to the ratio there is left.
    """
    return 0.5 * (math.log(there[1] / there[0]) - math.log(seen[1] / seen[0]))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, sizes: tuple[int, int]) -> tuple[DataFrame, tuple[int, int]]:
    """At most so many rows of either label, by a hash of doc_id, and how many of either there are; of several labels the highest counts.

    ``labels`` needs ``doc_id`` and the label (0, 1; nulls are left out).
    """
    one = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("_label"))
    there = {r["_label"]: r["count"] for r in one.groupBy("_label").count().collect()}
    picked = None
    for value in (0, 1):
        own = one.where(F.col("_label") == value).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sizes[value])
        picked = own if picked is None else picked.unionByName(own)
    rows = picked.collect()  # bounded by the sizes
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in rows] or [], "doc_id long, _label int")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "_label", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("_half"))
    return sample, (there.get(0, 0), there.get(1, 0))


def _gram_counts(batches):
    for batch in filled(batches):
        held: dict[tuple, int] = {}
        for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "_label", "_half"))):
            for word in set(words(text)):
                for gram in ngrams(word, ORDER):
                    held[gram, half, label] = held.get((gram, half, label), 0) + 1
        yield pa.RecordBatch.from_pydict(
            {"gram": pa.array([k[0] for k in held], pa.string()), "half": pa.array([k[1] for k in held], pa.int32()), "label": pa.array([k[2] for k in held], pa.int32()), "n": pa.array(list(held.values()), pa.int64())}
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sizes: tuple[int, int] = SAMPLE) -> Model:
    """Learn from labelled rows; words count once per text. Without either class every score is 0."""
    sample, there = sample_of(docs, labels, label, sizes)
    rows = sample.mapInArrow(_gram_counts, "gram string, half int, label int, n long").groupBy("gram").agg(
        *(F.sum(F.when((F.col("half") == h) & (F.col("label") == c), F.col("n")).otherwise(0)).alias(f"n{h}{c}") for h in (0, 1) for c in (0, 1))
    )
    counts = rows.toArrow()  # the n-grams of the sample, bounded as it is
    grams = counts["gram"].combine_chunks()
    n = np.stack([counts[c].to_numpy() for c in ("n00", "n01", "n10", "n11")], axis=1)

    def model(pairs):
        held = pairs.sum(axis=1) > 0
        return fitted(grams.filter(pa.array(held)), pairs[held], ORDER) if held.any() else {}

    # Plain arrays are sent: what is broadcast is pickled by reference, and workers need no copy of the package.
    sent = docs.sparkSession.sparkContext.broadcast([model(n[:, :2]), model(n[:, 2:])])

    def compare(batches):
        scorers = {}
        for batch in filled(batches):
            out = []
            for text, half in zip(batch.column("text").to_pylist(), batch.column("_half").to_pylist()):
                if half not in scorers:
                    scorers[half] = Scorer(sent.value[1 - half])
                out += scorers[half].features([text])
            yield pa.RecordBatch.from_pydict({"y": batch.column("_label"), "x": pa.array(out, pa.list_(pa.float64()))})

    seen = sample.mapInArrow(compare, "y int, x array<double>").collect()  # a row per text of the sample
    sent.destroy()
    y = np.array([r.y for r in seen])
    if not (y == 1).any() or not (y == 0).any():
        return Model({}, np.zeros(5), np.ones(5), np.zeros(6))
    centre, scale, weights = _logistic(np.array([r.x for r in seen]), y)
    weights[0] += sampling_shift(tuple(min(n, most) for n, most in zip(there, sizes)), there)
    return Model(model(n[:, :2] + n[:, 2:]), centre, scale, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); null and wordless texts compare as equal.

    Only ``text`` is looked at; an input column named like an added one gives way.
    """
    sent, schema = docs.sparkSession.sparkContext.broadcast(model.arrays), with_columns(docs.schema, *ADDED)
    name, curve = uuid.uuid4().hex, Model({}, model.centre, model.scale, model.weights)

    def run(batches):
        cache = worker_cache()
        if cache.get("toxicity", (None,))[0] != name:
            cache["toxicity"] = (name, Scorer(sent.value) if sent.value else None)
        scorer = cache["toxicity"][1]
        for batch in filled(batches):
            made = []
            for lo in range(0, batch.num_rows, 200):
                p = curve.curve(np.array(scorer.features(batch.column("text").slice(lo, 200).to_pylist()))) if scorer else np.zeros(min(200, batch.num_rows - lo))
                made.append(p)
            p = np.concatenate(made)
            made = {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema.fields], names=schema.names)

    return docs.mapInArrow(run, schema)
