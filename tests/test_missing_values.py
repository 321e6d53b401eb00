"""Nulls, NaN, impossible months and run records: the cases that fixtures rarely hold."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from innsight.functions.columns import is_canceled, month_abbr
from innsight.operators import audit, evaluate as E, profile as P, ranks
from innsight.session import ensure_checkpoint_dir, scratch_path
from innsight.sources.tables import latest_run, write_run_record


def test_spearman_leaves_out_nulls_pair_by_pair(spark):
    rows = [(i * 37 % 50, i * 11 % 23 if i % 4 else None, float(i % 7) if i % 9 else float("nan"), i) for i in range(200)]
    pdf = pd.DataFrame(rows, columns=["a", "b", "c", "d"], dtype="float64")
    df = spark.createDataFrame(rows, "a long, b long, c double, d long")
    needed = ["booking_status", "no_of_weekend_nights", "no_of_week_nights", "no_of_adults", "no_of_children"]
    df = df.withColumns({c: F.lit(1) if c != "booking_status" else F.lit("Canceled") for c in needed})
    want = pdf.corr(method="spearman")
    got = P.spearman_matrix(df, ["a", "b", "c", "d"]).collect()
    assert len(got) == 16
    for r in got:
        assert abs(r["rho"] - want.loc[r["row_feature"], r["col_feature"]]) < 1e-12
    # the shuffle join gives the same as the broadcast
    again = P.spearman_matrix(df, ["a", "d"], max_broadcast_rows=0).collect()
    assert {round(r["rho"], 12) for r in again} == {1.0, round(want.loc["a", "d"], 12)}


def test_nan_is_no_value_in_quantiles(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (None,)], "x double")
    assert ranks.exact_quantiles(df, "x", [0.5]).first()["value"] == 1.5
    ids = df.withColumn("Booking_ID", F.lit("i")).union(spark.createDataFrame([(99.0, "o")], "x double, i string"))
    assert audit.iqr_fence(ids, "x").first()["upper_fence"] is not None


@pytest.mark.parametrize("month", [-1, 0, 13, None])
def test_impossible_months_give_null_labels(spark, month):
    df = spark.createDataFrame([(2018, month, "Canceled"), (2018, 7, "Canceled")],
                               "arrival_year long, arrival_month long, booking_status string")
    got = {r["arrival_month"]: r[1] for r in df.select("arrival_month", month_abbr()).collect()}
    assert got == {month: None, 7: "Jul"}
    labels = {r["arrival_month"]: r["label"] for r in P.monthly_trend_label(df).collect()}
    assert labels == {month: None, 7: "Jul 18"}


def test_null_status_is_not_canceled(spark):
    df = spark.createDataFrame([("Canceled",), ("Not_Canceled",), (None,)], "booking_status string")
    assert sorted(r[0] for r in df.select(is_canceled()).collect()) == [0, 0, 1]
    assert abs(P.overall_cancel_rate(df).first()["cancel_rate_pct"] - 100 / 3) < 1e-9
    assert {(r["booking_status"], r["pct"]) for r in P.target_distribution(df).collect()} == {
        ("Canceled", 50.0), ("Not_Canceled", 50.0)}


def test_latest_run_is_the_last_one_written(spark):
    path = scratch_path(spark, "runs")
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for i, version in enumerate(("1.9.0", "1.10.0", "1.2.0")):
        write_run_record(spark, {"model_name": "m'x", "version": version, "threshold": 0.1 * i,
                                 "written_at": t + dt.timedelta(days=i if version != "1.2.0" else -1)}, path)
    assert latest_run(spark, path, "m'x")["version"] == "1.10.0"
    assert latest_run(spark, path, "other") is None


def test_duplicates_are_compared_in_full(spark):
    rows = [(1, None), (1, None), (None, 1), (2, 2), (2, 2), (2, 2), (3, 4)]
    assert audit.duplicate_rows(spark.createDataFrame(rows, "a int, b int")).first()[0] == 3
    assert audit.duplicate_rows(spark.createDataFrame([], "a int, b int")).first()[0] == 0


def test_isotonic_fit_of_collapsed_scores_is_the_same(spark):
    from pyspark.ml.regression import IsotonicRegression
    rows = [(i % 13 / 13.0, float((i * 7 % 13 + i % 5) > 8)) for i in range(400)]
    df = spark.createDataFrame(rows, "prob double, label double")
    full = IsotonicRegression(featuresCol="prob", labelCol="label").fit(df)
    mine = E.fit_isotonic(df)
    points = spark.createDataFrame([(i / 200,) for i in range(201)], "prob double")
    a = [r["prediction"] for r in full.transform(points).orderBy("prob").collect()]
    b = [r["prob_cal"] for r in E.apply_calibrator(points, mine, "isotonic").orderBy("prob").collect()]
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-12


def test_segments_of_null_and_repeated_keys_over_many_partitions(spark):
    rows = [(k, i, i % 3 + 1) for k in ("a", None, "b") for i in range(50)]
    got = ranks.segmented_prefix_sums(spark.createDataFrame(rows, "k string, i int, v long"), ["k"], ["i"], ["v"], 9)
    assert got.count() == 150
    for r in got.collect():
        assert r["v_before"] == sum(i % 3 + 1 for i in range(r["i"]))


def test_every_required_form_field_is_reported(spark):
    row = {f: "1" for f in audit.FORM_FIELDS} | {"check_in": "2018-01-01", "check_out": "2018-01-03"}
    schema = ", ".join(f"{f} string" for f in row)
    assert audit.validate_form(spark.createDataFrame([tuple(row.values())], schema)).first()["errors"] == []
    for f, message in audit.FORM_REQUIRED_ORDER:
        for empty in ("", None):
            bad = spark.createDataFrame([tuple({**row, f: empty}.values())], schema)
            assert audit.validate_form(bad).first()["errors"] == [f"{f}: {message}"]


def test_no_local_folder_on_a_cluster(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda k, d=None: d)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Cluster())
