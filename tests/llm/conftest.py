import random

import pytest

ODD = {"n_words": 7, "score": "x", "kept": "y", "block": 1, "fp": 2, "_x": 3}  # extra columns with clashing names


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta", "Épsilon", "zeta9", "eta", "ß", "theta.\n", "iota\t"]) + str(rng.randint(0, 60)) for _ in range(n))


def awkward_texts():
    """Nulls, empty texts, blanks only, one word, long texts, copies, near copies, shared passages, odd characters."""
    rng = random.Random(11)
    passage, other = sentence(rng, 30), sentence(rng, 70)
    long = sentence(rng, 9000)
    texts = [None, "", " \n\t ", "word", "two words", passage, passage, passage + " more", sentence(rng, 50) + " " + passage + "\n" + sentence(rng, 9)]
    texts += [other, other.replace("alpha", "alpha!", 1), other, long, long[:40000] + " end", "no", "a b c", "a  b\nc", "\x00 \x01 é́ <|endoftext|> 你好 \x1c x"]
    texts += ["same line\nsame line\nsame line\n", "rep eat rep eat rep eat rep eat rep eat rep eat", "x" * 300, "x" * 299 + "y", passage[:60]]
    texts += [sentence(rng, rng.randint(1, 80)) for _ in range(25)]
    return texts


@pytest.fixture(scope="session")
def texts():
    return awkward_texts()


@pytest.fixture(scope="session")
def rows(texts):
    """Ids are dealt at random: order of rows is not order of ids."""
    ids = random.Random(3).sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.fixture(scope="session")
def docs(spark, rows):
    kinds = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in ODD.items())
    data = [(i, t, None if i % 5 == 0 else "en", f"s{i % 2}" if i % 7 else None, *ODD.values()) for i, t in rows]
    return spark.createDataFrame(data, kinds).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
