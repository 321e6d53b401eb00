"""Hand-made micro tables for the edge cases of each rule."""

from pyspark.sql import functions as F

from innsight.functions.columns import (arrival_dow, arrival_parts, arrival_season, stay_nights,
                                        valid_arrival)
from innsight.operators import evaluate as E
from innsight.operators import features as FE
from innsight.operators import profile as P
from innsight.operators.scoring import default_cancellation_meta, price_comparison, recommendations


def test_lead_buckets_left_open(spark):
    df = spark.createDataFrame([(x, "Canceled") for x in (0, 14, 15, 500, 501)],
                               "lead_time long, booking_status string")
    got = {r["lead_bucket"]: r["n"] for r in P.cancel_rate_by_lead_bucket(df).collect()}
    # lead 0 and > 500 fall outside every bin; 14 closes the first bin
    assert got == {"0–14": 1, "15–30": 1, "365+": 1}


def test_dashboard_buckets_closed_at_zero(spark):
    df = spark.createDataFrame([(x, "Canceled") for x in (0, 14, 15, 150, 151)],
                               "lead_time long, booking_status string")
    got = {r["bucket"]: r["n"] for r in P.dashboard_lead_buckets(df).collect()}
    assert got == {"0–14 d": 2, "15–30 d": 1, "91–150 d": 1, "150+ d": 1}


def test_calendar_validity_and_weekday(spark):
    rows = [(2016, 2, 29), (2018, 2, 29), (2000, 2, 29), (1900, 2, 29), (2018, 13, 1), (2018, 4, 31)]
    df = spark.createDataFrame(rows, "arrival_year long, arrival_month long, arrival_date long")
    out = df.select(valid_arrival().alias("ok"), arrival_dow().alias("dow")).collect()
    assert [r["ok"] for r in out] == [True, False, True, False, False, False]
    assert out[0]["dow"] == 0  # 29 Feb 2016 was a Monday
    assert [r["dow"] for r in out[1:]] == [-1, 1, -1, -1, -1]


def test_season_mapping(spark):
    df = spark.createDataFrame([(m,) for m in [12, 1, 2, 3, 5, 6, 8, 9, 11, 0, 13]], "arrival_month long")
    got = [r[0] for r in df.select(arrival_season()).collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 3, 3, 0, 0]


def test_stay_nights_cases(spark):
    # fixed cases: Mon, Fri, Sat, Sun one night; Thu-Mon; Mon-Mon; Sat-Mon; Tue-Fri
    cases = [("2024-01-01", "2024-01-02", 1, 0), ("2024-01-05", "2024-01-06", 1, 0),
             ("2024-01-06", "2024-01-07", 0, 1), ("2024-01-07", "2024-01-08", 0, 1),
             ("2024-01-04", "2024-01-08", 2, 2), ("2024-01-01", "2024-01-08", 5, 2),
             ("2024-01-06", "2024-01-08", 0, 2), ("2024-01-02", "2024-01-05", 3, 0),
             ("2024-01-05", "2024-01-05", 0, 0), ("2024-01-05", "2024-01-01", 0, 0),
             ("", "2024-01-01", 0, 0), ("2024-02-30", "2024-03-02", 0, 0)]
    df = spark.createDataFrame(cases, "ci string, co string, wd int, we int")
    for r in df.select("wd", "we", stay_nights("ci", "co").alias("n")).collect():
        assert (r["n"]["weekday"], r["n"]["weekend"], r["n"]["total"]) == (r["wd"], r["we"], r["wd"] + r["we"])


def test_arrival_parts_no_calendar_check(spark):
    df = spark.createDataFrame([("2018-02-30",)], "d string")
    r = df.select(arrival_parts("d").alias("p")).first()["p"]
    assert (r["arrival_year"], r["arrival_month"], r["arrival_date"]) == (2018, 2, 30)


def test_risk_band_bounds(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.2999, 0.30, 0.5999, 0.60, 1.0)], "prob double")
    got = [r["risk_band"] for r in E.risk_bands(df).collect()]
    assert got == ["low", "low", "medium", "medium", "high", "high"]


def test_price_note_and_recommendation_gates(spark):
    meta = default_cancellation_meta(0.34)
    rows = [(100.0, 105.0, "low", 10, 1),   # exactly 5 %: not 'close'
            (100.0, 104.99, "low", 10, 1),  # under 5 %: close
            (100.0, 110.0, "low", 10, 1),   # exactly 10 %: note recommended
            (100.0, 109.96, "low", 10, 1),  # 9.96 rounds to 10.0 -> recommended
            (100.0, 109.94, "low", 10, 1),  # 9.9 -> not recommended
            (100.0, 80.0, "high", 200, 0),  # below + long lead + no requests
            (0.0, 50.0, "medium", 151, 2)]  # current 0 -> pct 0
    df = spark.createDataFrame(rows, "cur double, pred double, band string, lead long, req long")
    df = df.withColumn("pc", price_comparison("cur", "pred"))
    df = df.withColumn("recs", recommendations("band", "lead", "req", "pc", meta))
    out = df.select("pc", "recs").collect()
    assert out[0]["pc"]["note"].startswith("Predicted price is 5% above")
    assert out[1]["pc"]["note"].startswith("Predicted price closely")
    assert len(out[2]["recs"]) == 2 and len(out[3]["recs"]) == 2 and len(out[4]["recs"]) == 1
    assert out[5]["pc"]["note"].startswith("Current room price is 20% above")
    assert len(out[5]["recs"]) == 4
    assert out[6]["pc"]["difference_pct"] == 0.0 and len(out[6]["recs"]) == 2


def test_rare_category_limit_and_unseen(spark):
    rows = [("A",)] * 10 + [("B",)] * 9 + [("C",)] * 12
    train = spark.createDataFrame(rows, "type_of_meal_plan string")
    model = FE.RareCategoryOneHot(inputCols=["type_of_meal_plan"], minCount=10).fit(train)
    assert model.feature_names() == ["cat__type_of_meal_plan_A", "cat__type_of_meal_plan_C",
                                     "cat__type_of_meal_plan_infrequent_sklearn"]
    test = spark.createDataFrame([("A",), ("B",), ("Z",)], "type_of_meal_plan string")
    got = [tuple(r) for r in model.transform(test).drop("type_of_meal_plan").collect()]
    assert got == [(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 1.0)]
    # no rare category at fit time: an unseen value is all zeros
    m2 = FE.RareCategoryOneHot(inputCols=["type_of_meal_plan"], minCount=10).fit(
        spark.createDataFrame([("A",)] * 10, "type_of_meal_plan string"))
    assert [tuple(r) for r in m2.transform(test.limit(3)).drop("type_of_meal_plan").collect()] == \
        [(1.0,), (0.0,), (0.0,)]


def test_population_scaler_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = FE.PopulationScaler(inputCols=["a", "b"], outputCols=["za", "zb"]).fit(df)
    got = [(r["za"], r["zb"]) for r in m.transform(df).collect()]
    assert got == [(-1.0, 0.0), (1.0, 0.0)]


def test_threshold_sweep_matches_bruteforce(spark):
    import random
    rnd = random.Random(7)
    rows = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(400)] + [(0.3, 1), (0.05, 0)]
    df = spark.createDataFrame(rows, "prob double, label int")
    got = {r["threshold"]: r for r in E.threshold_sweep(df).collect()}
    for t in E.sweep_thresholds():
        tp = sum(1 for p, y in rows if p >= t and y == 1)
        fp = sum(1 for p, y in rows if p >= t and y == 0)
        fn = sum(1 for p, y in rows if p < t and y == 1)
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        assert abs(got[t]["f1"] - f1) < 1e-12


def test_reliability_edge_goes_to_lower_bin(spark):
    df = spark.createDataFrame([(0.1, 1, "x"), (0.1000001, 0, "x"), (1.0, 1, "x")],
                               "prob double, label int, split string")
    got = {r["bin"]: r["n"] for r in E.reliability_curve(df).collect()}
    assert got == {0: 1, 1: 1, 9: 1}


def test_auc_ties_count_half(spark):
    df = spark.createDataFrame([(0.5, 1, "s"), (0.5, 0, "s"), (0.9, 1, "s"), (0.1, 0, "s")],
                               "prob double, label int, split string")
    assert E.roc_auc(df).first()["roc_auc"] == 0.875
    const = spark.createDataFrame([(0.0, 1, "s"), (0.0, 0, "s")], "prob double, label int, split string")
    assert E.roc_auc(const).first()["roc_auc"] == 0.5


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4)], "v double")
    got = {r["bin"]: r["count"] for r in P.histogram(df, F.col("v"), 2).collect()}
    assert got == {0: 2, 1: 3}


def test_skew_safe_view_equals_window_text(spark):
    from tests.conftest import SF_SMALL
    from innsight.sources.bookings import derive_bookings, derive_bookings_sql
    a = derive_bookings(spark, SF_SMALL)
    b = derive_bookings_sql(spark, SF_SMALL)
    assert a.count() == b.count() == 1500
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_column_summary_counts_small_and_large_domains(spark, monkeypatch):
    from innsight.operators import audit
    monkeypatch.setattr(audit, "SMALL_DOMAIN", 50)
    nan = float("nan")
    rows = [(i, i % 7, [nan, 0.0, -0.0, 1.5, None][i % 5], None, f"v{i % 40}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, c double, d string, e string").repartition(3)
    got = {r["column_name"]: (r["n_unique"], r["n_null"]) for r in audit.column_summary(df).collect()}
    assert got == {"a": (3000, 0), "b": (7, 0), "c": (3, 600), "d": (0, 3000), "e": (40, 0)}
    assert [r["n_unique"] for r in audit.column_summary(df.limit(0)).collect()] == [0] * 5
    rough = {r["column_name"]: r["n_unique"] for r in audit.column_summary(df, exact=False).collect()}
    assert abs(rough["a"] - 3000) < 400 and rough["b"] == 7
