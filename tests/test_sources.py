import json

import pytest

from darwise import values as V
from darwise.operators import kpi
from darwise.sources import files
from darwise.streaming.intake import contract_stream, load_contracts
from tests.test_contracts import A, D


def test_inventory_round_trip(spark, inventory, tmp_path):
    for name, df in inventory.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    tables = files.read_inventory(spark, str(tmp_path), register=True)
    assert spark.sql("select count(*) from units u join sales s on s.unit_id = u.unit_id").first()[0] == 33
    export = kpi.sales_export(tables["sales"], tables["units"], tables["projects"])
    files.write_sales_csv(export, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.count() == 33 and back.columns[:2] == ["sale_id", "sale_date"] and len(back.columns) == 20
    files.write_metrics(kpi.kpi_snapshot(tables["units"], tables["sales"], tables["projects"]), f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/metrics").first()["units"]["total"] == 38


def test_contract_files_and_truth(spark, tmp_path):
    (tmp_path / "c_002.txt").write_bytes(D.replace("\n", "\r\n").encode())
    (tmp_path / "c 001+é.txt").write_text(A, encoding="utf-8")
    (tmp_path / "skip.json").write_text("{}")
    rows = {r["source"]: r["text"] for r in files.read_contracts(spark, str(tmp_path)).collect()}
    assert set(rows) == {"c_002.txt", "c 001+é.txt"} and rows["c_002.txt"] == D
    truth = {n: {**{f: None for f in V.CONTRACT_FIELDS}, "area_sqm": 3.5, "language": "ar", "template": "A", "planted_issue": None} for n in ("b", "a")}
    (tmp_path / "truth.json").write_text(json.dumps(truth, indent=1), encoding="utf-8")
    df = files.read_truth(spark, f"{tmp_path}/truth.json")
    assert df.columns == files.truth_columns() and df.count() == 2
    assert [r["source"] for r in files.read_truth(spark, f"{tmp_path}/truth.json", 1).collect()] == ["a"]


@pytest.mark.parametrize("indent, split", [(None, 150), (2, 150), (1, 1 << 27)])
def test_truth_in_splits(spark, tmp_path, indent, split):
    """Entries are found whatever lies at the cuts: braces and quotes in strings, splits in the middle, null records."""
    odd = ["plain", "a } b", '}"}', "{", 'q " { \\ "', "}}", "\\", "مشروع }", "", None, "line\nbreak }", "\\}"]
    truth = {f"c{i:03d} }}.txt" if i % 7 == 0 else f"c{i:03d}.txt": {**{f: None for f in V.CONTRACT_FIELDS}, "area_sqm": i + 0.5, "buyer_name": odd[i % len(odd)], "language": "ar", "template": "A", "planted_issue": odd[-1 - i % 5]} for i in range(60)}
    (tmp_path / "truth.json").write_text(json.dumps(truth, indent=indent, ensure_ascii=False), encoding="utf-8")
    settings = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        raw = spark.read.text(f"{tmp_path}/truth.json", lineSep="}")
        assert split > 1000 or raw.rdd.getNumPartitions() > 60  # entries are cut by splits
        got = {r["source"]: r for r in files.read_truth(spark, f"{tmp_path}/truth.json").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(got) == set(truth)
    for name, record in truth.items():
        assert {f: got[name][f] for f in ("area_sqm", "buyer_name", "language", "planted_issue")} == {f: record[f] for f in ("area_sqm", "buyer_name", "language", "planted_issue")}


def test_truth_of_nothing(spark, tmp_path):
    for name, text, wanted in (("a", "{}", 0), ("b", "", 0), ("c", " { } \n", 0), ("d", '{"x": {"area_sqm": 1.0}, "y": null}', 2), ("e", '{"x": {}}', 1)):
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
        assert files.read_truth(spark, f"{tmp_path}/{name}.json").count() == wanted, name


def test_length_guard_and_decoding(spark):
    df = spark.createDataFrame([("x" * 20,), ("  " + "x" * 19 + " \n",), (None,)], "text string")
    good, bad = files.split_by_length(df)
    assert good.count() == 1 and bad.count() == 2
    raw = spark.createDataFrame([(bytearray(b"ab\xff"),)], "b binary")
    assert raw.select(files.decode_utf8("b").alias("t")).first()["t"] == "ab�"


def test_contracts_as_a_stream(spark, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    inbox.mkdir()
    (inbox / "1.txt").write_text(A, encoding="utf-8")
    (inbox / "2.txt").write_text("short", encoding="utf-8")
    load_contracts(contract_stream(spark, str(inbox)), out, check).awaitTermination(120)
    (inbox / "3.txt").write_text(D, encoding="utf-8")
    load_contracts(contract_stream(spark, str(inbox)), out, check).awaitTermination(120)
    got = {r["source"]: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {"1.txt", "3.txt"}
    assert got["1.txt"]["record"]["unit_type"] == "villa" and got["3.txt"]["needs_review"]
    assert [r["source"] for r in spark.read.parquet(out + "-rejected").collect()] == ["2.txt"]


def test_scratch_tables_go_with_their_scope(spark, monkeypatch, tmp_path):
    import os

    from darwise.sources import scratch

    monkeypatch.setattr(scratch, "scratch_folder", lambda _: str(tmp_path))
    with scratch.scratch(spark):
        assert scratch.stored(spark.range(5)).count() == 5
        with scratch.scratch(spark):
            scratch.stored(spark.range(2))
            assert len(os.listdir(tmp_path)) == 2
        assert len(os.listdir(tmp_path)) == 1
    assert os.listdir(tmp_path) == []
