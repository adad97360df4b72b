"""Operator 11 against whole-number and numpy arithmetic over all rows."""

import math
import random

import numpy as np
import pytest

from darwise.llm import whitening
from darwise.llm.queries import REGISTRY

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component string"


def brute(rows, scale=256, components=4):
    """Per id and vector what is expected, up to the sign of a component."""
    sound = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in sound]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    sound = [(i, x) for i, x in sound if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in sound}), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = np.array([[float(a) for a in row] for row in (n * fit - s)]) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in sound:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
        z = np.array([float(n * a - b) for a, b in zip(x, s)]) / n
        for c in range(min(components, d)):
            real = e[c] > 1e-9
            out.append((i, c + 1, n, dev, abs(z @ u[:, c]) / math.sqrt(e[c]) if real else 0.0, e[c] / e.sum() if real else 0.0))
    return sorted(out, key=str)


def compare(got, rows, **kw):
    expected = brute(rows, **kw)
    found = sorted(((r["vec_id"], r["component"], r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]) for r in got), key=str)
    key = lambda r: (str(r[:4]), r[4])
    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    np.testing.assert_allclose([r[4:] for r in found], [r[4:] for r in expected], rtol=1e-7, atol=1e-7)
    assert len({r["identity_error"] for r in got}) <= 1 and all(r["identity_error"] < 1e-9 for r in got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    spread = [9, 5, 3, 2, 1, 0.5]
    rows = [(i, [rng.gauss(0.3, s / 10) for s in spread]) for i in range(300)]
    hot = rows[7][1]
    rows += [(1000 + i, list(hot)) for i in range(150)] + [(7, list(hot)), (None, [0.1] * 6)]
    rows += [(2000, None), (2001, []), (2002, [0.1] * 5 + [None]), (2003, [0.1] * 5 + [float("nan")]), (2004, [0.1] * 5 + [float("-inf")])]
    rows += [(2005, [0.2] * 3), (2006, [0.0] * 6), (2007, [-0.0] * 6), (2008, [-0.001] * 6)]
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", 2, "b") for i, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block_bytes", [whitening.BLOCK_BYTES, 48 * 7])
def test_equals_brute_force(spark, rows, frame, block_bytes):
    """nulls, empty, short and non-finite vectors, repeated rows, a hot vector, clashing columns; one block, and many in a square"""
    got = whitening.whiten(frame, block_bytes=block_bytes)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), rows)


def test_one_sign_for_all_rows(spark, rows, frame):
    got = {}
    for r in whitening.whiten(frame).collect():
        got.setdefault((r["vec_id"], int(r["deviation"])), {})[r["component"]] = r["whitened"]
    sound = [v for v in got.values()]
    w = np.array([[v[c] for c in range(1, 5)] for v in sound])
    assert len(np.unique(np.round(w, 9), axis=0)) > 250  # not absolute values
    assert (w < -0.1).any(axis=0).all() and (w > 0.1).any(axis=0).all()


def test_few_rows_and_no_variance(spark):
    make = lambda data: spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make([(1, None)])).collect() == []
    one = whitening.whiten(make([(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one) == [
        (i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)
    ]
    rows = [(i, [i / 8, i / 4, 1.0, 0.0, 0.0]) for i in range(9)]  # one direction only
    compare(whitening.whiten(make(rows)).collect(), rows)


def test_entries_beyond_64_bits_of_squares(spark):
    rows = [(i, [2.0**40 * i, -(2.0**50) + i, float(i * i)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    expected = {r[0]: r[3] for r in brute(rows)}
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == expected and max(expected.values()) > 2**63


def test_query(spark, rows, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = REGISTRY["op11_embedding_whitening"](spark, str(tmp_path))
    assert dict(out.dtypes)["deviation"] == "bigint"
    compare(out.collect(), rows)
