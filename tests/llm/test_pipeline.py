"""The corpus pipeline: each stage against brute force on its own input, and the whole run."""

import itertools
import random
import re

import pytest

import corpus_pipeline as C
from darwise.llm.queries import vocabulary
from tests.llm.test_judges import brute_hits
from tests.llm.test_repeats import brute_simhash, word_dedup

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    """Documents with extra columns, labels by whether a text is prose, a small benchmark."""
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    data = [(i, t) for i, t in rows] + [(1000 + i, prose(rng.randint(15, 90))) for i in range(300)] + [(2000 + i, " | ".join(prose(40).split())) for i in range(120)]
    data += [(3000, data[60][1]), (3001, None), (3002, data[61][1] + " " + data[62][1])]
    labels = [(i, int("|" not in (t or "|"))) for i, t in data if i >= 1000]
    items = [(1, " ".join(data[70][1].split()[:14])), (2, "not there at all")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, score string, _docs long"
    full = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "clash", 9) for i, t in data]
    spark.createDataFrame(full, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_every_stage_on_its_own_input(spark, tables):
    folder, items = tables
    docs = C.table(spark, folder, "documents")
    columns = docs.columns
    stages = dict(C.STAGES)
    assert [*stages] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]

    judged = C.saved(spark, stages["quality_classifier"](spark, docs, folder), "t")
    ids = {i for i, _ in pairs(judged)}
    assert judged.columns == columns and sum(2000 <= i < 2120 for i in ids) <= 2 and sum(1000 <= i < 1300 for i in ids) >= 298
    assert judged.subtract(docs).count() == 0  # rows are as they were

    # The next stages are tried on all documents, awkward ones included.
    near = C.saved(spark, stages["simhash_near_dedup"](spark, docs, folder), "t")
    least = {i: c for i, (_, c) in brute_simhash(pairs(docs)).items()}
    assert sorted(i for i, _ in pairs(near)) == sorted(i for i, c in least.items() if i == c)
    assert near.columns == columns and near.subtract(docs).count() == 0

    cut = C.saved(spark, stages["substring_dedup"](spark, docs, folder), "t")
    want = word_dedup(pairs(docs), 20)
    before = dict(pairs(docs))
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns and len(got) == docs.count()
    for i, (_, removed, kept) in want.items():
        assert got[i]["text"] == (kept if removed else before[i])
        assert got[i]["n_chars"] == (None if got[i]["text"] is None else len(got[i]["text"])) and got[i]["score"] == "clash"

    clean = C.saved(spark, stages["benchmark_decontamination"](spark, docs, folder), "t")
    dirty = {i for i, hit in brute_hits(pairs(docs), items).items() if hit[3]}
    assert dirty and sorted(i for i, _ in pairs(clean)) == sorted(set(before) - dirty) and clean.columns == columns

    whole = tokenizers.Tokenizer.from_file(vocabulary())
    packed = stages["best_fit_packing"](spark, docs, folder).collect()
    lengths = {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}
    for i, own in itertools.groupby(sorted(packed, key=lambda r: (r["doc_id"], r["piece"])), key=lambda r: r["doc_id"]):
        assert sum(r["length"] for r in own) == lengths.pop(i)
    assert not lengths


def test_run_and_empty_table(spark, tables, tmp_path):
    folder, _ = tables
    out = C.run(spark, folder)
    assert out.count() > 200 and "sequence_id" in out.columns
    for name in ("labels", "benchmark"):
        C.table(spark, folder, name).write.parquet(f"{tmp_path}/{name}.parquet")
    C.table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids_keep_one_document(spark, tables):
    folder, _ = tables
    text = "a text of a few words"
    rows = [(5, text), (5, text), (7, text), (None, "another one that has no number"), (8, re.sub("few", "lot", text))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = C.simhash_near_dedup(spark, docs, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == [(False, 5), (False, 8), (True, None)]


def test_groups_that_share_a_doc_id_keep_one_document_each(spark, tables):
    folder, _ = tables
    rng = random.Random(9)
    prose = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(200))
    a, b, c = prose(), prose(), prose()
    # 5 stands on two texts; the group of c has a smaller doc_id than its row of 5; 6 and 7 are copies.
    rows = [(5, a), (5, a), (5, b), (6, a), (7, b), (5, c), (4, c)]
    rows += [(9, a.upper()), (5, a.upper())]  # a near copy of one doc_id in one group
    kept = C.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()
    assert sorted((r["doc_id"], r["text"].lower()) for r in kept) == sorted([(5, a), (5, b), (4, c)])
