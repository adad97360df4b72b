import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from darwise.operators import absorption as A, kpi, pricing
from darwise.operators.median import grouped_median


def test_snapshot_adds_up(inventory):
    s = kpi.kpi_snapshot(inventory["units"], inventory["sales"], inventory["projects"]).first()
    u = s["units"]
    assert u["total"] == u["available"] + u["reserved"] + u["sold"] == 38
    assert sum(p["sold"] for p in s["by_project"]) == u["sold"] == 33
    assert [p["project"] for p in s["by_project"]] == ["Alpha", "Beta", "Delta", "Gamma"]
    assert s["financing_mix"] == {"cash": 6, "bank_financing": 27}
    assert str(s["as_of"]) == "2025-12-31"
    sales = inventory["sales"].toPandas()
    day = pd.to_datetime(sales["sale_date"])
    # 31 December less three months is "31 September", which runs into 1 October
    assert s["last_3_months"]["units_sold"] == int((day >= "2025-10-01").sum())
    assert s["last_3_months"]["units_sold_previous"] == int(((day < "2025-10-01") & (day >= "2025-07-01")).sum())


def test_price_per_area_skips_empty_areas(inventory):
    beta = kpi.by_project(inventory["units"], inventory["sales"], inventory["projects"]).filter("project = 'Beta'").first()
    assert beta["avg_price_per_sqm"] == round(np.mean([(300000.0 + n) / 80 for n in range(1, 8)]))


def test_empty_tables(spark, inventory):
    units, sales = inventory["units"].limit(0), inventory["sales"].limit(0)
    assert kpi.status_totals(units).first()["total"] == 0
    assert kpi.momentum(sales).first()["units_sold"] == 0
    assert A.monthly_absorption(sales, inventory["projects"]).count() == 0


def test_unit_stats_have_both_levels(inventory):
    rows = {(r["project_id"], r["unit_type"]): r for r in kpi.unit_stats(inventory["units"]).collect()}
    assert rows[("P1", None)]["n_units"] == 28 and rows[("P1", None)]["available"] == 3
    assert rows[("P1", "villa")]["n_units"] + rows[("P1", "apartment")]["n_units"] == 28


def test_median_is_exact_with_one_group_of_nearly_all_rows(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=30001), np.full(20000, 0.25), rng.integers(0, 5, 999)])
    keys = np.where(np.arange(len(values)) % 50 > 0, "hot", np.where(np.arange(len(values)) % 7 == 0, "b", None))
    pdf = pd.DataFrame({"k": keys, "v": values})
    pdf.loc[5, "v"] = np.nan
    pdf.loc[len(pdf)] = ["only null", np.nan]
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    got = {r["k"]: r["median"] for r in grouped_median(df, ["k"], "v").collect()}
    want = pdf.groupby("k", dropna=False)["v"].median()
    assert set(got) == {None, "hot", "b", "only null"}
    for k, v in want.items():
        key = None if pd.isna(k) else k
        assert got[key] == pytest.approx(v) if not pd.isna(v) else got[key] is None
    assert grouped_median(df, [], "v", "m").first()["m"] == pytest.approx(pdf["v"].median())


def test_monthly_series(inventory):
    m = A.monthly_absorption(inventory["sales"], inventory["projects"]).toPandas()
    assert set(m["project_id"]) == {"P1", "P2", "P4"}  # P3 never sold
    assert m.groupby("project_id").size().nunique() == 1  # dense
    p2 = m[m["project_id"] == "P2"].set_index(m[m["project_id"] == "P2"]["month"].astype(str))["units"]
    assert np.isnan(p2["2024-05-01"]) and p2["2024-06-01"] == 1 and p2["2024-07-01"] == 0


# Damped trend by hand: of [0, 5] the level after the second value is 4.625 and the trend 4.325.
@pytest.mark.parametrize(
    "y, naive, mean, damped",
    [([3], 3, 3, [3, 3, 3]), ([2, 2], 2, 2, [2, 2, 2]), ([0, 5], 5, 2.5, [8.30125, 11.4260625, 14.082153125]), ([9, 0], 0, 4.5, [0, 0, 0])],
)
def test_forecasters(spark, y, naive, mean, damped):
    r = spark.createDataFrame([([float(v) for v in y],)], "y array<double>").select(
        A.naive_last("y", 3).alias("n"), A.mean_3("y", 3).alias("m"), A.damped_trend("y", 3).alias("d")
    ).first()
    assert r["n"] == [naive] * 3 and r["m"] == pytest.approx([mean] * 3) and r["d"] == pytest.approx(damped)


def test_backtest_and_forecast(inventory):
    monthly = A.monthly_absorption(inventory["sales"], inventory["projects"]).persist()
    got = {r["project_id"]: r for r in A.forecast_absorption(monthly, kpi.remaining_units(inventory["units"])).collect()}
    assert set(got) == {"P1", "P2"}  # the others have too few months
    pdf = monthly.toPandas().dropna().sort_values("month")
    for pid, r in got.items():
        y = pdf[pdf["project_id"] == pid]["units"].astype(float).tolist()
        origins = range(len(y) - 6, len(y))
        want = {
            "naive_last": np.mean([abs(y[c - 1] - y[c]) for c in origins]),
            "mean_3": np.mean([abs(np.mean(y[:c][-3:]) - y[c]) for c in origins]),
        }
        mae = r["backtest_mae"].asDict()
        assert {m: mae[m] for m in want} == pytest.approx(want) and mae["damped_trend"] >= 0
        assert mae[r["method"]] <= min(mae.values()) + 1e-9
        assert str(r["forecast"][0]["month"]) == "2026-01-01" and len(r["forecast"]) == 6
        mean = np.mean([f["units"] for f in r["forecast"]])
        if mean > 0.05:
            assert r["months_of_inventory"] == pytest.approx(r["remaining_units"] / mean)
        else:
            assert r["months_of_inventory"] is None
    assert got["P1"]["remaining_units"] == 3 and got["P1"]["last_3_months"] == [2, 2, 2]


def test_equal_errors_pick_the_first_method(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0)], "mae_naive_last double, mae_mean_3 double, mae_damped_trend double")
    assert df.select(A.best_method().alias("m")).first()["m"] == "naive_last"


@pytest.fixture(scope="module")
def priced(spark):
    """Prices that depend on project, type and area in a way the baseline cannot see."""
    rng = np.random.default_rng(7)
    n = 900
    pdf = pd.DataFrame(
        {
            "sale_id": np.arange(n),
            "project_id": rng.choice(["NRJ", "CST", "KHM"], n),
            "unit_type": rng.choice(["villa", "apartment"], n),
            "city": "Riyadh",
            "view": rng.choice(["sea", "street"], n),
            "payment_method": rng.choice(["cash", "bank_financing"], n),
            "bedrooms": rng.integers(2, 6, n),
            "bathrooms": rng.integers(1, 5, n),
            "area_sqm": rng.uniform(80, 400, n),
            "floor": rng.integers(0, 9, n),
            "parking_spaces": 1,
            "month": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 24, n) * 31, unit="D"),
        }
    )
    pdf["month"] = pdf["month"].dt.to_period("M").dt.to_timestamp().dt.date
    pdf["month_index"] = 0
    pdf["project_name"] = pdf["project_id"]
    base = pdf["project_id"].map({"NRJ": 5000, "CST": 9000, "KHM": 7000}) * np.where(pdf["unit_type"] == "villa", 1.3, 1.0)
    pdf["sale_price_sar"] = base * pdf["area_sqm"] ** 0.8 * 3 * rng.normal(1, 0.02, n)
    return spark.createDataFrame(pdf)


def test_permutations_are_whole_and_independent(spark):
    """places are dense and the same for any partitioning; every row is donor once, and features share no shuffle"""
    df = spark.range(1000).select(F.col("id").alias("sale_id"))
    one = {r["sale_id"]: r["_at"] for r in pricing.shuffled_index(df.repartition(7)).collect()}
    assert sorted(one.values()) == list(range(1000)) and one == {r["sale_id"]: r["_at"] for r in pricing.shuffled_index(df.repartition(2)).collect()}
    assert [one[i] for i in range(1000)] != list(range(1000)) and pricing.shuffled_index(df.limit(0)).count() == 0
    seen = []
    for feature, repeat in [("area_sqm", 0), ("area_sqm", 1), ("floor", 0)]:
        a, b = pricing.permutation(feature, repeat)
        seen.append([(a * i + b) % 1000 for i in range(1000)])
        assert sorted(seen[-1]) == list(range(1000))
    for x, y in ((0, 1), (0, 2), (1, 2)):
        assert sum(p == q for p, q in zip(seen[x], seen[y])) < 100


def test_price_model(spark, priced, tmp_path):
    model, report = pricing.train_price_model(priced, path=str(tmp_path / "m"), iterations=60)
    assert report.n_train + report.n_test == 900
    m = {r["predictor"]: r for r in report.metrics.collect()}
    assert m["predicted"]["mape"] < m["baseline"]["mape"] and m["predicted"]["r2"] > 0.9
    importance = [r["feature"] for r in report.importance.collect()]
    assert len(importance) == 11 and set(importance[:2]) <= {"area_sqm", "project_id", "unit_type"}
    assert report.by_project_mape.count() == 3
    loaded = pricing.load_price_model(str(tmp_path / "m"))
    unit = spark.createDataFrame(
        [("NRJ", "villa", "sea", 5, 300.0, None, 2), ("NEW", "villa", "sea", 5, 300.0, None, 2)],
        "project_id string, unit_type string, view string, bedrooms int, area_sqm double, floor int, parking_spaces int",
    )
    rows = pricing.score_units(loaded, unit).collect()
    assert len(rows) == 2 and all(1_000_000 < r["estimated_price_sar"] < 10_000_000 for r in rows)
    assert rows[0]["city"] == "Riyadh" and rows[0]["payment_method"] == "bank_financing" and rows[0]["bathrooms"] == 4
    assert spark.read.json(str(tmp_path / "m" / "metrics")).count() == 2


def test_small_test_set_is_refused(priced):
    with pytest.raises(ValueError, match="too small"):
        pricing.train_price_model(priced.limit(15), iterations=2)


def test_baseline_falls_back_to_the_overall_median(spark):
    train = spark.createDataFrame([("P", "villa", 100.0, 1000.0), ("P", "flat", 100.0, 3000.0)], "project_id string, unit_type string, area_sqm double, sale_price_sar double")
    test = spark.createDataFrame([("P", "villa", 10.0), ("Q", "villa", 10.0)], "project_id string, unit_type string, area_sqm double")
    got = {r["project_id"]: r["baseline"] for r in pricing.predict_baseline(train, test).collect()}
    assert got == {"P": 100.0, "Q": 200.0}
