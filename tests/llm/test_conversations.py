"""Operator 12 against a trie built in memory, and what it is made of."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from darwise.llm import conversations as C, listrank
from darwise.llm.queries import REGISTRY
from darwise.llm.running import running

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn int, role string, text string, depth string, node int, words string"


def said(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def read(rows):
    """The turns of each conversation in order."""
    every = {}
    for c, turn, role, text in rows:
        if c is not None:
            every.setdefault(c, []).append((turn is not None, turn or 0, said(role or "", text or "")[:30], role or "", text or ""))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in every.items()}


def rebuild(every):
    out = {}
    for c, own in every.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
        out[c] = every.get(base, [])[:h] + own[h:]
    return out


def brute(every):
    nodes = {}
    for c, turns in every.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        parents = {q[:-1] for q in nodes if q}
        ends = sorted(c for c in members if len(every[c]) == len(p))
        out.append(
            (
                min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(1 for q in nodes if q and q[:-1] == p), sum(q not in parents for q in below),
                sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    lines = ["hello there", "", "  ", "a b\tc", "é ü x", "same words again and again"]
    rows = []
    for c in [*range(0, 45), 100, 101, 119, 121, -3, -20, 10**12]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "assistant", None]), rng.choice(lines + [None])))
    rows += [(200 + i, t, "user", lines[t % 3]) for i in range(60) for t in range(4)]  # copies
    rows += [(300, t, "user", f"turn {t}") for t in range(120)] + [(301, t, "user", f"turn {t}") for t in range(118)]  # long ones
    rows += [(400, 1, "user", "twice"), (400, 1, "user", "twice"), (400, 1, None, "other"), (None, 1, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("chunk, last", [(C.CHUNK, C.LAST), (7, 20)])
def test_trie(spark, rows, frame, chunk, last):
    """nulls, copies, long conversations, repeated rows, equal turn numbers, clashing columns; and by rounds of the list ranking"""
    assert found(C.prefix_trie(C.conversations(frame), chunk, last)) == brute(read(rows))


def test_query_rebuilds_conversations(spark, rows, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(REGISTRY["op12_conversation_trie"](spark, str(tmp_path))) == brute(rebuild(read(rows)))


def test_turnless_conversations_and_empty_tables(spark, frame):
    assert found(C.prefix_trie(C.conversations(frame.limit(0)))) == []
    assert found(C.prefix_trie(C.rebuilt(frame.limit(0), 20, lambda c: F.lit(1), 3))) == []
    one = spark.createDataFrame([(5, 0, "user", "a b")], "conv_id long, turn long, role string, text string")
    got = found(C.prefix_trie(C.rebuilt(one, 20, lambda c: F.lit(2), 3)))
    assert got == [(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]


@pytest.mark.parametrize("n, last", [(1, 3), (500, 1000), (3000, 40)])
def test_list_ranking(spark, n, last):
    """a list in no order, with weights"""
    rng = random.Random(n)
    ids = rng.sample(range(10 * n), n)
    weight = [rng.randint(1, 5) for _ in ids]
    data = [(i, j, w) for i, j, w in zip(ids, [*ids[1:], None], weight)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id long, next long, weight long").repartition(5)
    expected = dict(zip(ids, np.cumsum([0, *weight[:-1]]).tolist()))
    assert {r["id"]: r["at"] for r in listrank.ranked(df, ids[0], 50, last).collect()} == expected
    assert {r["id"]: r["at"] for r in listrank.divided(df, ids[0], last).collect()} == expected


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(8)
    data = [(rng.choice([1, 1, 1, 2, 3]) if i % 2 else 7, i, rng.randint(0, 100), rng.randint(0, 96)) for i in range(3000)]
    df = spark.createDataFrame(data, "k long, o long, v long, m long").repartition(6)
    expected, sums = {}, {}
    for k, o, v, m in sorted(data):
        a, b = sums.get(k, (0, 0))
        sums[k] = (a + v, b + m)
        expected[(k, o)] = sums[k]
    plain = running(df, ["k"], ["o"], ["v", "m"])
    assert plain.columns == df.columns and {(r["k"], r["o"]): (r["v"], r["m"]) for r in plain.collect()} == expected
    rest = running(df, ["k"], ["o"], ["v", "m"], [1009, 97])
    assert {(r["k"], r["o"]): (r["v"], r["m"]) for r in rest.collect()} == {k: (a % 1009, b % 97) for k, (a, b) in expected.items()}
    assert running(df.limit(0), ["k"], ["o"], ["v"]).count() == 0
