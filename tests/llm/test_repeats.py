"""Operators 1, 4 and 10 against brute force."""

import itertools
import re

import numpy as np
import pytest
import xxhash

from darwise.llm import components, exchange, language_model, quality_rules, simhash, substrings, suffixes
from darwise.llm.text import run_hashes, sequence_hashes, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def byte_dedup(rows, window):
    seen, out = {}, {}
    ordered = sorted(rows, key=lambda r: r[0])
    for i, t in ordered:
        b = (t or "").encode()
        for at in range(len(b) - window + 1):
            seen.setdefault(b[at : at + window], i)
    for i, t in ordered:
        b, gone = (t or "").encode(), set()
        for at in range(len(b) - window + 1):
            if seen[b[at : at + window]] < i:
                gone.update(range(at, at + window))
        spans = sum(1 for g in gone if g - 1 not in gone)
        out[i] = (len(b), len(gone), spans, bytes(c for k, c in enumerate(b) if k not in gone))
    return out


def word_dedup(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w, gone = WORD.findall(t or ""), set()
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            if key in seen:
                gone.update(range(at, at + window))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_cover_and_steiner_system():
    differences = {(a - b) % suffixes.MODULUS for a in suffixes.COVER for b in suffixes.COVER}
    assert differences == set(range(suffixes.MODULUS))
    for lost in itertools.combinations(range(8), 3):
        assert any(not set(lost) & set(b) for b in simhash.BLOCKS)
    assert len(simhash.BLOCKS) == 14 and all(len(b) == 4 for b in simhash.BLOCKS)


def test_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 2**64, 50, dtype=np.uint64)
    for length in (1, 5, 7, 10, 20):
        twice = sequence_hashes(np.concatenate([values, values]), length)
        assert len(twice) == 101 - length and (twice[:30] == twice[50:80]).all() and len(set(twice[:50].tolist())) == 50
    assert len(sequence_hashes(values, 51)) == 0
    data = rng.integers(0, 256, 700, dtype=np.uint8)
    twice, at = np.concatenate([data, data]), np.arange(0, 600, 7)
    for length in (8, 20, 50):
        assert (window_hashes(twice, at, length) == window_hashes(twice, at + 700, length)).all()
    for size in (0, 1, 7, 8, 9, 63, 64, 65, 100):
        h = run_hashes(twice, np.append(at, at + 700), np.append(at, at + 700) + size)
        assert (h[: len(at)] == h[len(at) :]).all() and (size < 7 or len(set(h.tolist())) == len(at))
    assert len(set(run_hashes(np.frombuffer(b"a\0\0a\0a", np.uint8), np.array([0, 0, 0, 3, 5]), np.array([1, 2, 3, 5, 6])).tolist())) == 3


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_constructed_texts(spark):
    """Two words that sums of powers modulo 2**64 take for equal, whatever the base."""
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    lead = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{lead} {one}"), (2, f"{lead} {two}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(df).collect()} == {1: 0, 2: 0}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup_bytes(df).collect()}
    assert got == byte_dedup(rows, 50)
    known = {r["doc_id"]: r["n_known"] for r in language_model.score(df, language_model.fit(df.where("doc_id = 1"))).collect()}
    assert known == {1: 21, 2: 20}  # the end is known
    lines = spark.createDataFrame([(1, f"{one}\n{two}", "en", "web"), (2, f"{one}\n{one}", "en", "web")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.judge(lines).collect()} == {1: 0, 2: 1}
    # Windows of two words in that order.
    a, b = (" ".join(thue_morse(64, *own)) for own in ("ab", "ba"))
    assert word_dedup([(1, a), (2, b)], 20) == {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.dedup_substrings(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}


@pytest.mark.parametrize("window, block_bytes", [(50, 2 << 20), (40, 5000)])
def test_suffixes(docs, rows, monkeypatch, window, block_bytes):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(exchange.make_blocks, "__defaults__", (block_bytes,))
    out = suffixes.dedup_bytes(docs, window).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out}
    assert len(out) == len(rows) and got == byte_dedup(rows, window)
    assert out[0]["block"] == 1 and "lang" in out[0]  # other columns stay


@pytest.mark.parametrize("window, block_bytes", [(20, 2 << 20), (20, 3000), (7, 3000)])
def test_substrings(docs, rows, monkeypatch, window, block_bytes):
    monkeypatch.setattr(exchange.make_blocks, "__defaults__", (block_bytes,))
    out = substrings.dedup_substrings(docs, window).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out}
    assert len(out) == len(rows) and got == word_dedup(rows, window)


def test_repeated_ids_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (5, "short " + text + " " + text)], "doc_id long, text string")
    gone = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substrings.dedup_substrings(df).collect())
    # A null id is the smallest; rows of one id leave each other alone.
    assert gone == [(-1, 0), (5, 40), (5, 40), (5, 80)]
    same = df.where("doc_id = 5")
    gone = sorted(r["n_removed"] for r in substrings.dedup_substrings(same).collect())
    assert gone == [0, 0, 40]
    assert sorted(r["n_removed"] for r in suffixes.dedup_bytes(same).collect()) == [0, 0, 0]


def test_empty_tables(none):
    assert suffixes.dedup_bytes(none).count() == 0
    assert substrings.dedup_substrings(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


def brute_simhash(rows):
    prints = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(prints, 2):
            if bin(prints[a] ^ prints[b]).count("1") <= 3 and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return {i: (f"{prints[i]:016x}", least[i]) for i in prints}


@pytest.mark.parametrize("long_list", [50_000, 2])
def test_simhash(docs, rows, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    out = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == brute_simhash(rows) and len(out) == len(rows)


@pytest.mark.parametrize("long_list", [50_000, 3])
def test_links_of_fingerprints(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = {int(b) for b in base} | {0}
    for _ in range(300):  # chains of small steps, and dense clusters
        f = int(rng.choice(np.array(sorted(fps), np.uint64)))
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            f ^= 1 << int(bit)
        fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components.connected(simhash.links(df)).collect()}
    groups = {}
    for f, lab in zip(fps.view(np.int64), label):
        groups.setdefault(lab, set()).add(roots.get(int(f), int(f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
