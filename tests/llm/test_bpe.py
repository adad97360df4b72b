"""Operator 13: equal to the tokenizers library, text by text, there and back."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from darwise.llm import bpe
from darwise.llm.queries import REGISTRY, vocabulary
from darwise.llm.text import slices
from tests.llm.test_tokens import ODD

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = "abcdefghij'stmdrevll  0123é ñÄß²<|endoftext|>\x85\xa0\xad\u0301你a--''.,ΣİAB\n\x1c\x00😀"


@pytest.fixture(scope="module")
def whole():
    return tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.Vocabulary(vocabulary())


def compare(own, whole, texts, size=4 << 20):
    for part in slices(pa.array(texts, pa.string()), size):
        ids, bounds = own.encode(part)
        decoded, ends = own.decode(ids, bounds)
        for k in range(part.hi - part.lo):
            expected = whole.encode(texts[part.lo + k] or "", add_special_tokens=False).ids
            assert ids[bounds[k] : bounds[k + 1]].tolist() == expected
            assert decoded[ends[k] : ends[k + 1]].tobytes().decode() == whole.decode(expected, skip_special_tokens=False)


def test_equals_the_library_on_awkward_texts(own, whole, texts):
    compare(own, whole, ODD + texts + ["ab " * 30000 + "x" * 20000])
    compare(own, whole, texts, size=1)  # every text by itself


def test_equals_the_library_on_random_texts(own, whole):
    rng = random.Random(1)
    compare(own, whole, ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 70))) for _ in range(3000)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_equals_the_library_on_any_text(own, whole, found):
    compare(own, whole, found + [None])


def test_merges_whose_product_merges_earlier_are_done_one_by_one(tmp_path):
    """a vocabulary where merging all places of a pair at once would go wrong"""
    letters = [bpe.BYTE_CHARS[b] for b in range(256)]
    # (abc, ab) has a lower rank than (ab, c), which makes abc.
    merges = [("abc", "ab"), ("a", "b"), ("ab", "c"), ("abcab", "c")]
    names = letters + [c + "</w>" for c in letters] + ["ab", "abc", "abcab", "abcabc"]
    held = json.loads(open(vocabulary(), encoding="utf-8").read())
    held["model"]["vocab"], held["model"]["merges"], held["added_tokens"] = {s: i for i, s in enumerate(names)}, merges, []
    path = str(tmp_path / "small.json")
    open(path, "w", encoding="utf-8").write(json.dumps(held))
    made = bpe.Vocabulary(path)
    assert made.alone.any()
    rng = random.Random(2)
    compare(made, tokenizers.Tokenizer.from_file(path), ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(500)] + ["abcabcabcz", "abcabcz"])


def test_other_vocabularies_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_frames(spark, docs, rows, none, whole):
    """nulls, empty, long and repeated texts, extra columns, an empty table"""
    got = bpe.decode_ids(bpe.encode_texts(docs.unionByName(docs), vocabulary()), vocabulary())
    assert got.columns == docs.columns + ["ids", "decoded"]
    found = [(r["doc_id"], r["ids"], r["decoded"]) for r in got.collect()]
    expected = []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        expected += 2 * [(i, np.asarray(ids, "<u4").tobytes(), whole.decode(ids, skip_special_tokens=False))]
    assert sorted((a, bytes(b), c) for a, b, c in found) == sorted(expected)
    assert bpe.encode_texts(none, vocabulary()).count() == 0


def test_clashing_columns_and_strange_ids(spark):
    df = spark.createDataFrame([(None, "a b", "x", 1), (None, "a b", "x", 1), (1, None, None, None)], "doc_id long, text string, IDS string, Decoded int")
    got = bpe.decode_ids(bpe.encode_texts(df, vocabulary()), vocabulary())
    assert got.columns == ["doc_id", "text", "ids", "decoded"] and sorted(r["decoded"] for r in got.collect()) == ["", "a</w> b</w>", "a</w> b</w>"]
    odd = spark.createDataFrame([(None,), (b"",), (np.asarray([320, 10**9, 320], "<u4").tobytes(),)], "ids binary")
    assert sorted(r["decoded"] for r in bpe.decode_ids(odd, vocabulary()).collect()) == ["", "", "a</w> a</w>"]


def test_query_equals_the_library(spark, whole, tmp_path, docs, rows):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in REGISTRY["op13_bpe"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        text = whole.decode(ids, skip_special_tokens=False)
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
