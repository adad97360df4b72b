"""Operators 6 and 9: whole encodings, exact round trips, gapless packing."""

import zlib

import numpy as np
import pytest

from darwise.llm import files, packing, token_files
from darwise.llm.queries import vocabulary
from darwise.llm.tokens import Encoder

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(vocabulary())


def ids_of(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids


ODD = [
    "", None, "Ｆoo’s  <|endoftext|>x a b\x1cq É́ İstanbul ΑΣ Σ", "don't I'LL 'd's it's''re x'veX 12a3 \x00\x7f a\x85b",
    "é ́x  y <|ENDOFTEXT|> a<|startoftext|>", "ß ﬁ ŉ Ǆ ẞ ² ¼ª µº«»\xad\xa0", "<|endoftext|><", "x" * 5000, "你好 мир",
]


def test_encoding_by_parts_equals_whole_texts(whole, texts):
    own = Encoder(vocabulary())
    every = ODD + texts
    assert own.encode(every) == [np.asarray(ids_of(whole, t), "<u4").tobytes() for t in every]


def test_a_full_memory_changes_nothing(whole, texts, monkeypatch):
    monkeypatch.setattr("darwise.llm.tokens.KEPT_PIECES", 10)
    assert Encoder(vocabulary()).encode(texts, many=5) == [np.asarray(ids_of(whole, t), "<u4").tobytes() for t in texts]


def test_token_files(spark, docs, rows, whole, tmp_path):
    folder = str(tmp_path / "tokens")
    manifest = token_files.write_tokens(docs, folder, vocabulary(), end_id=1)
    got = {r["doc_id"]: r for r in token_files.read_tokens(spark, folder, with_ids=True).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = np.asarray(ids_of(whole, t) + [1], "<u4")
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())) and bytes(r["ids"]) == ids.tobytes()
        start += len(ids)
    assert manifest["tokens"] == start and manifest["docs"] == len(rows) == len(got) and manifest["width"] == 2
    flat = b"".join((tmp_path / "tokens" / f"part-{p['part']:06d}.ids").read_bytes() for p in manifest["parts"])
    assert len(flat) == 2 * start  # unsigned 16-bit, one file after the other


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (2, "a"), (None, "c"), (2, "b")], "doc_id long, text string")
    folder = "file://" + str(tmp_path / "tokens")
    token_files.write_tokens(df, folder, vocabulary(), end_id=1)
    got = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 2, 2, 2] and got[2]["ids_crc32"] == got[3]["ids_crc32"] != got[1]["ids_crc32"]


def test_empty_tables(spark, none, tmp_path):
    assert token_files.write_tokens(none, str(tmp_path / "t"), vocabulary(), end_id=1)["tokens"] == 0
    assert token_files.read_tokens(spark, str(tmp_path / "t")).count() == 0
    assert packing.pack(none, vocabulary()).count() == 0


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, rows, whole, capacity):
    out = packing.pack(docs, vocabulary(), end_id=0, capacity=capacity, with_ids=True).collect()
    want = {}
    for i, t in rows:
        ids = ids_of(whole, t) + [0]
        for p in range(-(-len(ids) // capacity)):
            want[i, p] = (p * capacity, ids[p * capacity : (p + 1) * capacity])
    assert {(r["doc_id"], r["piece"]): (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in out} == want and len(out) == len(want)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 for r in out)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= capacity


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = 50
    histogram = {int(n): int(rng.integers(1, 400)) for n in rng.choice(np.arange(1, capacity + 1), 12, replace=False)}
    plan = packing.plan(histogram, capacity)
    held, ranks = {}, {n: set() for n in histogram}
    for length, lo, hi, sequence, each, offset in plan:
        for rank in range(lo, hi):
            assert rank not in ranks[length]
            ranks[length].add(rank)
            held.setdefault(sequence + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
    assert all(ranks[n] == set(range(histogram[n])) for n in histogram)
    for own in held.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= capacity
    # One by one: each piece, longest first, to the fullest sequence that has room.
    room = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fitting = [(r, k) for k, r in enumerate(room) if r >= n]
        if fitting:
            room[min(fitting)[1]] -= n
        else:
            room.append(capacity - n)
    assert len(held) == len(room)


def test_paths_go_through_the_default_file_system(spark, tmp_path):
    """A folder without a scheme is what Spark takes it for, on the driver and in tasks."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "file:///")
        assert files.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
        assert files.place(files.qualified(spark, f"{tmp_path}/a"))[1] == f"{tmp_path}/a"
        conf.set("fs.defaultFS", "viewfs://other/")
        conf.set("fs.viewfs.mounttable.other.link./ckpt", f"file://{tmp_path}")
        assert files.qualified(spark, "/ckpt/model") == "viewfs://other/ckpt/model"
    finally:
        conf.set("fs.defaultFS", before)
    assert files.qualified(spark, "s3a-like/relative").startswith("file:/")
