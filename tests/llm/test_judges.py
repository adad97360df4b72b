"""Operators 2, 3, 5, 7 and 8: brute force, hand-made cases and held-out accuracy."""

import collections
import math
import os
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from darwise.llm import decontaminate as D, language_model as L, quality_model as Q, quality_rules as R, toxicity as T
from darwise.llm.kneser_ney_words import SharedBackoff, Steps, fitted, ngrams
from darwise.llm.text import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- 3: decontamination ---------------------------------------------------------------
@pytest.fixture(scope="module")
def items(rows):
    rng = random.Random(2)
    texts = [t for _, t in rows if t and len(t.split()) > 20]
    cut = [" ".join(t.split()[3:20]) for t in rng.sample(texts, 6)]
    return [(i, t) for i, t in enumerate([*cut, cut[0], "two words", "Word", "", None, "nowhere to be found", "beta1", "?!"])]


def brute_hits(rows, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = norm(t)
        for at in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[at : at + 13])].add(str(i))
    out = {}
    for i, t in rows:
        w, hit, found = norm(t), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[tuple(w[at : at + n])]
        out[i] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("nodes", [D.NODES, 900])
def test_decontamination(spark, docs, rows, items, nodes):
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.decontaminate(docs, bench, nodes=nodes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in out} == brute_hits(rows, items)
    assert len(out) == len(rows) and any(r["contaminated"] for r in out)
    texts = dict(rows)
    for r in out:  # spans are places in the original
        pieces = [texts[r["doc_id"]].encode()[s["start"] : s["end"]].decode() for s in r["hit_spans"]]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ".join(pieces).translate(LOWER))
        assert len(words) == r["n_hit"]


def test_automata_are_bounded(spark):
    """One long item, repeated and null item ids: blocks hold no more nodes than asked for, and all windows."""
    import ahocorasick

    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(3000))
    bench = spark.createDataFrame([("a", long), ("a", long), (None, "few words"), ("b", None), ("c", "")], "item_id string, text string")
    blocks = [D._by_pattern(b) for b in D.pattern_blocks(bench, nodes=50_000)]
    assert sum(map(len, blocks)) == 3000 - 12 + 1 and len(blocks) > 5
    for patterns in blocks:
        made = ahocorasick.Automaton()
        for key in patterns:
            made.add_word(key, 1)
        made.make_automaton()
        assert made.get_stats()["nodes_count"] <= 50_000
    got = D.decontaminate(spark.createDataFrame([(1, "some FEW words here")], "doc_id long, text string"), bench, nodes=50_000).first()
    assert (got["n_hit"], got["item_ids"]) == (2, ["None"])


def test_decontamination_of_nothing(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, bench).where("contaminated or n_hit > 0").count() == 0
    assert D.decontaminate(none, bench).count() == 0


# --- 7: language model ------------------------------------------------------------------
def brute_model(rows, train, order):
    """Tokens, counts of single tokens, and the share of a token after a tuple of tokens, from dicts."""
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), "\n"] for i, t in rows}
    c = collections.Counter(w for i in train for w in tokens[i])
    padded = [["\r"] * (order - 1) + tokens[i] for i in train]
    grams = {order: collections.Counter(tuple(t[k : k + order]) for t in padded for k in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):  # below the highest order, how many different tokens stand before
        grams[k] = collections.Counter(g[1:] for g in grams[k + 1])
    classes = collections.defaultdict(lambda: [0, 0, 0, 0])  # of a context: all counts, followers counted 1, 2, 3 times or more
    for k in range(1, order + 1):
        for g, n in grams[k].items():
            classes[g[:-1]][0] += n
            classes[g[:-1]][min(n, 3)] += 1
    cut = {k: [0, *L.discounts([sum(1 for x in grams[k].values() if x == j) for j in (1, 2, 3, 4)])] for k in grams}

    def share(w, before):
        p = 1 / (len(c) + 1)
        for k in range(1, order + 1):
            context = tuple(before[len(before) - k + 1 :])
            total, *seen = classes.get(context, (0, 0, 0, 0))
            if total:
                n = grams[k][(*context, w)]
                p = (n - cut[k][min(n, 3)] + sum(a * b for a, b in zip(cut[k][1:], seen)) * p) / total
        return p

    return tokens, c, share


@pytest.mark.parametrize("order, rounds", [(2, 4), (3, 4), (3, 1), (4, 2)])
def test_language_model(docs, rows, order, rounds):
    train = {i for i, _ in rows if i % 3}
    out = L.score(docs, L.fit(docs.where("doc_id % 3 <> 0"), order=order, rounds=rounds)).collect()
    tokens, c, share = brute_model(rows, train, order)
    n = sum(c.values())
    assert len(out) == len(rows)
    for r in out:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in own))
        padded = ["\r"] * (order - 1) + own
        assert r["score"] == pytest.approx(sum(math.log10(share(w, padded[k : k + order - 1])) for k, w in enumerate(own)))
    # Shares of all words after others, and of one unknown word, add up to one.
    for before in (["\r", "\r", "beta5"], ["beta5", "beta5", "beta5"], ["\r"] * 3, ["never", "seen", "before"]):
        assert sum(share(w, before) for w in c) + share("unknown", before) == pytest.approx(1)


@pytest.mark.parametrize("level", [1, 2, 3, 4])
def test_words_from_hashes(level):
    words = np.random.default_rng(level).integers(0, 1 << 32, (level, 1000), dtype=np.uint32)
    assert (L.words_of(L.gram_key(words), words[2:], level) == words).all()


@pytest.mark.parametrize("level", [3, 4])
def test_key_of_a_context(level):
    words = np.random.default_rng(level).integers(0, 1 << 32, (level, 1000), dtype=np.uint32)
    assert (L.context_key(L.gram_key(words), words[-1]) == L.gram_key(words[:-1])).all()


@pytest.mark.parametrize("width", [1, 5, 21, 22, 24, 25, 29, 30, 32])
@pytest.mark.parametrize("level", [1, 2, 3, 4, 5])
def test_words_from_keys_and_tails(level, width):
    """Words of few bits fill 64, so that of the third only what is left stands in the tails, in as few bytes as hold it."""
    words = np.random.default_rng(level).integers(0, 1 << width, (level, 1000), dtype=np.uint32)
    words[:, 0], words[:, 1] = 0, (1 << width) - 1
    key, tails = L.keyed(words, width)
    raw = L._tail_bytes(tails, L.third_type(width))
    assert len(raw) == 1000 * (0 if level < 3 else (1 if width <= 24 else 2 if width <= 26 else 4) + 4 * (level - 3))
    tails = np.array(L._tails(raw, 1000, max(0, level - 2)), np.uint32).reshape(-1, 1000)
    assert (L.unkeyed(key, tails, level, width) == words).all()
    if level > 3:
        assert (L.context_key(key, tails[-1]) == L.keyed(words[:-1], width)[0]).all()


def test_numbers_of_words_have_room():
    """Of the numbers of a width the largest is for words not in training."""
    for distinct in (0, 1, 2, 5, 6, 7, 1 << 20, 0xFFFFFFFE):
        unknown = int(L.UNKNOWN >> np.uint32(32 - L.width_of(distinct)))
        assert unknown > distinct and unknown <= 2 * distinct + 1


@pytest.mark.parametrize("rounds", [1, 3, 4, 50])
def test_each_bucket_has_one_round(rounds):
    key = np.sort(np.concatenate([np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64), np.array([0, (1 << 64) - 1, 1 << 59, (1 << 59) - 1], np.uint64)]))
    parts = [L._in_round(key, 5, rounds, number) for number in range(rounds)]
    assert np.concatenate(parts).tolist() == list(range(len(key)))
    held = [{bucket for bucket, *_ in L._by_bucket(key[part], 5)} for part in parts]
    assert sum(map(len, held)) == len(set().union(*held)) == 32
    assert list(L._by_bucket(key[-3:], 5)) == [(31, 0, 3)] and not list(L._by_bucket(key[:0], 5))


def test_stored_ngrams_are_small_and_read_seldom(docs, tmp_path, monkeypatch):
    """A triple takes ten bytes where words have up to 24 bits; files are read once a round, for words in half of the rounds."""
    told, tell = [], L._tell
    monkeypatch.setattr(L, "_tell", lambda folder, bits, level, *more: told.append(level) or tell(folder, bits, level, *more))
    folder = L.fit(docs, str(tmp_path / "model"), rounds=4)
    assert told == [3] * 4 + [2] * 2
    stored, meta = L.Stored(folder, L.LEAST_BITS), L.Model(folder).meta
    held = [(f"{tmp_path}/model/grams3-{b:06d}", stored.file(3, b)) for b in range(1 << L.LEAST_BITS) if stored.file(3, b)]
    assert meta["width"] <= 24 and sum(len(keys) for _, (keys, *_) in held) > 5000
    for path, (keys, _, _, many, _) in held:
        assert os.path.getsize(path) == 32 + 10 * len(keys) + 16 * len(many)


def test_words_are_looked_up_once(docs, rows, monkeypatch):
    """Single words are found by the different words of a slice, not by its tokens; what is found is the same."""
    folder, asked, of = L.fit(docs), {}, L.Stored.of
    monkeypatch.setattr(L.Stored, "of", lambda self, level, key, *more: asked.setdefault(level, []).append(len(key)) or of(self, level, key, *more))
    texts = [t for _, t in rows]
    (part,) = slices(pa.array(texts), 1 << 30)
    own, bounds = L.tokens(part)
    count, share = L.Model(folder).log_shares(own, bounds)
    tokens, c, _ = brute_model(rows, {i for i, _ in rows}, 3)
    assert len(own) == max(asked[0]) > 2 * len(c) and max(asked[1]) == len(c)
    assert count.tolist() == [c[w] for i, _ in rows for w in tokens[i]]
    one = {r["doc_id"]: r["score"] for r in L.score(docs, folder).collect()}
    assert np.add.reduceat(share, bounds[:-1]) == pytest.approx([one[i] for i, _ in rows])


def test_ngrams_of_one_hash():
    """N-grams that share a hash but not their last word stay apart."""
    key, tails = np.array([7, 5, 7, 7, 5], np.uint64), np.array([[2, 1, 1, 2, 1]], np.uint32)
    order, heads = L._grouped(key, tails)
    assert [(int(key[i]), int(tails[0, i])) for i in order[heads]] == [(5, 1), (7, 1), (7, 2)]
    assert np.diff(np.append(heads, 5)).tolist() == [2, 1, 2]


def test_sums_of_groups():
    key, columns = np.array([7, 5, 7, 7, 5], np.uint64), [np.array([1, 2, 3, 4, 1 << 40]), np.arange(5)]
    order, heads = L._grouped(key)
    assert L._sums(columns, order, heads).tolist() == [[(1 << 40) + 2, 5], [8, 5]]
    assert L._sums([c[:0] for c in columns], *L._grouped(key[:0])).shape == (0, 2)


def test_numbers_above_a_byte():
    n = np.array([[0, 254], [255, 256], [1, 1 << 40]])
    assert L.unpacked(L.packed(n), 6).reshape(3, 2).tolist() == n.tolist()


def test_model_with_frequent_words(spark):
    """Counts over 255 at every level, repeated rows and rows without a doc_id."""
    rows = [(i % 50, "the cat the dog the cat") for i in range(300)] + [(None, "the dog"), (None, None)]
    ids = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens, c, share = brute_model(ids, set(range(len(rows))), 3)
    want = sorted(round(sum(math.log10(share(w, (["\r", "\r"] + own)[k : k + 2])) for k, w in enumerate(own)), 8) for own in tokens.values())
    out = L.score(df, L.fit(df)).collect()
    assert sorted(round(r["score"], 8) for r in out) == want and {r["train_tokens"] for r in out} == {sum(c.values())}


def test_model_refuses_single_words(docs):
    with pytest.raises(ValueError):
        L.fit(docs, order=1)


def test_language_model_of_nothing(docs, none):
    out = L.score(docs, L.fit(none)).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["score"] == r["base_score"] == 0 for r in out)
    assert L.score(none, L.fit(docs)).count() == 0


def test_discounts():
    assert L.discounts([0, 0, 0, 0]) == [0.5] * 3
    d = L.discounts([100, 40, 20, 10])
    y = 100 / 180
    assert d == pytest.approx([1 - 2 * y * 0.4, 2 - 3 * y * 0.5, 3 - 4 * y * 0.5])


# --- 8: rules -----------------------------------------------------------------------------
def brute_figures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(again)


def test_rules(docs, rows):
    out = R.judge(docs).collect()
    assert len(out) == len(rows) and out[0]["block"] == 1
    for r in out:
        want = brute_figures(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"] and not r["failed_rules"])


def test_bounds_blend_with_group_size(spark):
    """Bounds equal a plain blend of quantiles, and move in small steps as a group grows."""
    rng = random.Random(3)
    spread = lambda n, low, high: [(rng.randint(low, high), 100) for _ in range(n)]
    ratio, seen = "symbol_ratio", []
    base = [("en", "web", *x) for x in spread(300, 0, 9)] + [("de", "web", *x) for x in spread(50, 20, 40)] + [(None, None, 5, 100)]
    own = spread(200, 50, 90)

    def plain(groups, key):
        quantile = lambda v: [sorted(v)[max(0, math.ceil(q * len(v)) - 1)] for q in R.QUANTILES]
        every = [x for v in groups.values() for x in v]
        out = quantile(every)
        for held in ([x for k, v in groups.items() if k[0] == key[0] for x in v], groups[key]):
            w = 1 / (1 + (R.HALF / len(held)) ** R.STEEP)
            out = [w * a + (1 - w) * b for a, b in zip(quantile(held), out)]
        return out

    sizes = (1, 30, 98, 99, 100, 101, 149, 150, 151, 200)
    for n in sizes:
        data = base + [("en", "forum", *x) for x in own[:n]]
        figures = spark.createDataFrame(data, "lang string, source string, n_symbols long, word_chars long").withColumns({c: F.lit(10) for c in R.FIGURES if c not in ("n_symbols", "word_chars")})
        bounds = {(r["lang"], r["source"]): r[ratio] for r in R.blended(R.thresholds(figures), ("lang", "source")).collect()}
        groups = {}
        for lang, source, above, below in data:
            groups.setdefault((lang or "\0", source or "\0"), []).append(above / below)
        assert set(bounds) == set(groups)
        for key in groups:
            assert bounds[key] == pytest.approx(plain(groups, key))
        seen.append(bounds["en", "forum"][2])
    by_size = dict(zip(sizes, seen))
    assert all(abs(by_size[n] - by_size[n + 1]) < 0.05 for n in (98, 99, 100, 149, 150))


def test_rules_adapt_to_their_group(spark, none):
    rng = random.Random(1)
    prose = lambda: " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(60))
    code = lambda: " ".join(f"{w} & {w[::-1]} <" for w in prose().split()[:30])
    rows = [(i, prose(), "en", "web") for i in range(200)] + [(i, code(), "en", "code") for i in range(200, 400)]
    rows += [(900, code(), "en", "web"), (901, code(), None, None), (902, prose(), "en", "rare")]
    out = {r["doc_id"]: r for r in R.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i]["kept"] for i in range(400))  # symbols are usual in one source
    assert not out[900]["kept"] and "symbol_ratio" in out[900]["failed_rules"]
    assert out[901]["kept"] and out[902]["kept"]  # small groups use the bounds of larger ones
    assert R.judge(none).count() == 0


def test_every_rule_rejects_something(spark):
    rng = random.Random(5)
    word = lambda least=2, most=9: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(least, most)))
    prose = lambda n=100, **of: [word(**of) for _ in range(n)]
    lines = lambda held: "\n".join(" ".join(prose(4)) + ("\nok" if held else "") for _ in range(40))
    again, few = prose(8), prose(6)
    odd = {
        "symbol_ratio": [" ".join(w + "#" for w in prose())],
        "dup_line_ratio": [lines(True)],
        "repeat_ratio": [" ".join([*prose(42), *again, *prose(42), *again])],
        "word_length": [" ".join(prose(least=18, most=22)), " ".join(prose(least=2, most=2))],
        "upper_ratio": [" ".join(prose()).upper()],
        "mark_ratio": [" ".join(w + "!" for w in prose())],
        "distinct_ratio": [" ".join(rng.choices(few, k=60))],
    }
    texts = [" ".join(prose()) for _ in range(150)] + [lines(False) for _ in range(50)]
    wanted = [None] * len(texts) + [rule for rule, own in odd.items() for _ in own]
    texts += [t for own in odd.values() for t in own]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in R.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert set(odd) == set(R.RULES) and not any(out[i]["base_failed"] for i in out)
    for i, rule in enumerate(wanted):
        assert out[i]["kept"] if rule is None else rule in out[i]["failed_rules"]


# --- 2: toxicity ----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def rude(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("aeioustrlmn") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["zqwkert", "vyxgrump", "kjhsnort"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(base, k=rng.randint(5, 120))
        if i % 6 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "ing", "s"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "12 !!")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(rude):
    docs, labels = rude
    model = T.fit(docs, labels.where("doc_id % 5 <> 0"))
    out = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    wrong = [i for i in range(0, 600, 5) if out[i]["predicted"] != int(i % 6 == 0)]
    assert len(wrong) <= 1 and all(0 <= r["score"] <= 1 for r in out.values())
    assert out[1000]["score"] == out[1001]["score"] == out[1002]["score"] and out[1000]["predicted"] == 0


def test_toxicity_without_labels(docs, none, rude):
    empty = rude[1].limit(0)
    assert {r["score"] for r in T.score(docs, T.fit(docs, empty)).collect()} == {0.0}
    assert T.score(none, T.fit(none, empty)).count() == 0


def arrays(counts, order):
    return fitted(pa.array(list(counts)), np.array(list(counts.values())), order)


def test_toxicity_sees_whole_stems_and_shares():
    counts = collections.defaultdict(lambda: [0, 0])
    # Every piece of five characters of the toxic word is as usual in ordinary texts.
    usual = ["achlosen", "pachlicter", "uchlichm", "fachlicher", "lichkeit"]
    for word, n in [*((w, (50, 50)) for w in usual), ("achlich", (0, 10))]:
        for g in ngrams(word, T.ORDER):
            for c in (0, 1):
                counts[g][c] += n[c]
    model = SharedBackoff({g: tuple(n) for g, n in counts.items()}, T.ORDER)
    scorer = T.Scorer(arrays(counts, T.ORDER))
    assert model.log_ratio("achlich") > 3 and model.log_ratio("achlichs") > 3
    assert all(model.log_ratio(w) < 1 for w in usual)
    few, many = scorer.features([" ".join(usual[:1] * (300 - n) + ["achlich"] * n) for n in (3, 12)])
    assert len(few) == 5 and all(b - a > 0.2 for a, b in zip(few[3:], many[3:], strict=True))


def test_toxicity_scores_mean_the_same_at_every_sample():
    rng = np.random.default_rng(3)
    y = (np.arange(40_000) % 10 == 0).astype(int)
    x = rng.normal(size=(len(y), 1)) + 1.5 * y[:, None]
    every = T.Model({}, *T._logistic(x, y))
    held = (y == 1) | (rng.random(len(y)) < 0.2)  # all toxic texts, a fifth of the ordinary ones
    centre, scale, weights = T._logistic(x[held], y[held])
    there, seen = (tuple(np.bincount(v)) for v in (y, y[held]))
    at = np.linspace(-2, 4, 13)[:, None]
    assert np.abs(T.Model({}, centre, scale, weights).curve(at) - every.curve(at)).max() > 0.1
    weights[0] += T.sampling_shift(seen, there)
    assert T.Model({}, centre, scale, weights).curve(at) == pytest.approx(every.curve(at), abs=0.03)


def test_toxicity_fit_corrects_for_its_sample(rude, monkeypatch):
    docs, labels = rude
    monkeypatch.setattr(T, "_logistic", lambda x, y: (x.mean(0), np.ones(x.shape[1]), np.zeros(1 + x.shape[1])))
    assert T.fit(docs, labels, sizes=(100, 100)).weights[0] == pytest.approx(-0.5 * math.log(5))  # of 500 and 100
    assert T.fit(docs, labels).weights[0] == 0


def test_shared_backoff_shares_add_up():
    rng = random.Random(5)
    counts = collections.defaultdict(lambda: [0, 0])
    for k in range(300):
        for g in ngrams("".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))), 4):
            counts[g][k % 2] += 1
    m = SharedBackoff({g: tuple(n) for g, n in counts.items()}, 4)
    letters = sorted({g[-1] for g in counts})
    for context in ("\x02", "\x02a", "abc", "bcd", "dd", ""):
        assert sum(m.shared(context + x) for x in letters) == pytest.approx(1 - m.shared(context + "?"), abs=1e-9)
    assert m.step("zzz") == 0.0


@pytest.mark.parametrize("order", [2, 4, 8])
def test_steps_equal_the_model(order):
    """the arrays workers get give the ratios of the model, for words known, half known and unknown"""
    rng = random.Random(order)
    word = lambda letters, most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    counts = collections.defaultdict(lambda: [0, 0])
    for k in range(400):
        for g in ngrams(word("abcdé", 12), order):
            counts[g][int(rng.random() < 0.3)] += 1
    model = SharedBackoff({g: tuple(n) for g, n in counts.items()}, order)
    steps = Steps(arrays(counts, order), order)
    asked = [word("abcdéxß你", 14) for _ in range(500)] + ["a", "abcabcabcabc", "zzz"]
    assert steps.log_ratios(asked) == pytest.approx([model.log_ratio(w) for w in asked], abs=1e-9)
    assert steps.log_ratios([]).tolist() == []


def test_toxicity_with_repeated_rows_and_null_ids(spark, rude):
    """equal texts score alike, whatever their ids; columns named like the added ones give way"""
    docs, labels = rude
    model = T.fit(docs, labels)
    odd = spark.createDataFrame([(None, "plain words here", "a", 1), (None, "plain words here", "b", 2), (5, None, None, None), (5, "", "", 0), (6, "word " * 40000, "", 0)], "doc_id long, text string, score string, PREDICTED int")
    got = T.score(odd, model).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "text", "score", "predicted"}
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in by_text.values())


# --- 5: classifier -----------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(900):
        n = rng.randint(20, 150)
        kind = i % 5
        text = {3: lambda: " | ".join(word() for _ in range(n)), 4: lambda: " ".join([word()] * n)}.get(kind, lambda: " ".join(word() for _ in range(n)) + ".")()
        rows.append((i, text))
        labels.append((i, int(kind < 3)))
    rows += [(2000, None), (2001, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    measured = Q.with_figures(docs)
    out = {r["doc_id"]: r for r in Q.score(measured, Q.fit(measured, labels.where("doc_id % 4 <> 1"))).collect()}
    wrong = [i for i in range(1, 900, 4) if out[i]["predicted"] != int(i % 5 < 3)]
    assert len(wrong) <= 2 and all(0 <= r["score"] <= 1 for r in out.values()) and out[2000]["score"] == out[2001]["score"]


def test_quality_without_labels(docs, none):
    labels = docs.select("doc_id", F.lit(1).alias("quality")).limit(0)
    measured = Q.with_figures(docs)
    assert {r["score"] for r in Q.score(measured, Q.fit(measured, labels)).collect()} == {1.0}
    assert Q.score(Q.with_figures(none), Q.fit(Q.with_figures(none), labels)).count() == 0


def test_isotonic():
    x, y = np.arange(6.0), np.array([0, 2, 1, 0, 4, 4.0])
    knots, levels = Q.isotonic(x, y, np.array([4.0, 4, 4, 4, 4, 4]))
    assert knots.tolist() == [0, 1, 3, 4, 5] and levels.tolist() == [0, 0.25, 0.25, 1, 1]


def test_buckets_follow_the_text_alone(spark, docs):
    """more shuffle partitions make no more buckets: each sends a row to each of the level below"""
    before, bits = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            bits.append(L.Model(L.fit(docs.limit(8), order=2, rounds=1)).meta["bits"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert bits == [L.LEAST_BITS] * 2
