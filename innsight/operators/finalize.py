"""Production flows: fit on train, calibrate and pick the threshold on
validation, read test once, and describe the result as metadata.

Nothing is fitted on validation or test rows except the calibrator and the
threshold (validation only), as in the study.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.operators import evaluate as E
from innsight.operators import models as M
from innsight.operators.calibrated import calibrated_pipeline
from innsight.operators.scoring import default_cancellation_meta
from innsight.schema import BOOKING_COLUMNS
from innsight.session import side_by_side, written

FEATURES_REQUIRED = [n for n, _ in BOOKING_COLUMNS if n not in ("Booking_ID", "booking_status")]


def calibration_table(val_scored: DataFrame, label: str = "label", score: str = "prob"):
    """Brier score of raw, isotonic and sigmoid probabilities on validation;
    isotonic is chosen when its Brier score is not higher than sigmoid's.

    Returns (table, chosen method, chosen calibrator)."""
    spark = val_scored.sparkSession
    iso, sig = side_by_side(spark, lambda: E.fit_isotonic(val_scored, label, score),
                            lambda: E.fit_sigmoid(val_scored, label, score))
    a = E.apply_calibrator(val_scored, iso, "isotonic", score, "p_iso")
    b = E.apply_calibrator(a, sig, "sigmoid", score, "p_sig")
    y = F.col(label)
    row = b.agg(F.avg(F.pow(F.col(score) - y, 2)).alias("raw"),
                F.avg(F.pow(F.col("p_iso") - y, 2)).alias("iso"),
                F.avg(F.pow(F.col("p_sig") - y, 2)).alias("sig")).first()
    method = "isotonic" if row["iso"] <= row["sig"] else "sigmoid"
    table = spark.createDataFrame(
        [("uncalibrated", float(row["raw"]), False), ("isotonic", float(row["iso"]), method == "isotonic"),
         ("sigmoid", float(row["sig"]), method == "sigmoid")],
        "method string, brier_score double, chosen boolean")
    return table, method, (iso if method == "isotonic" else sig)


def finalize_cancellation(split_df: DataFrame, version: str = "1.0.0", **gbt_params) -> dict:
    """Boosted classifier on train -> calibrator and threshold on val ->
    metrics on every split. Returns a dict of models, tables and metadata. What doesn't
    need the trees runs beside the fit, which is one task for a table within ``nodeRows``."""
    spark = split_df.sparkSession
    model, dummy, n_train = side_by_side(
        spark, lambda: M.fit_boosted_classifier(split_df, **gbt_params),
        lambda: E.classification_metrics(M.fit_dummy_classifier(split_df).transform(split_df), 0.5).collect(),
        lambda: split_df.where("split = 'train'").count())
    scored = M.predict_classifier(model, M.over_cores(split_df)).select(
        "Booking_ID", "label", "split", "prob", "lead_time", "no_of_special_requests")
    scored = written(scored, "scored")     # three numbers a row; nothing stays cached
    val = scored.where("split = 'val'")
    (cal_table, method, calibrator), raw_test = side_by_side(
        spark, lambda: calibration_table(val),
        lambda: E.classification_metrics(scored.where("split = 'test'"), 0.5).withColumn("model", F.lit("raw")))
    cal = written(E.apply_calibrator(scored, calibrator, method, "prob", "prob_cal"), "calibrated")
    sweep = E.threshold_sweep(cal.where("split = 'val'"), score="prob_cal")
    test = cal.where("split = 'test'")
    threshold = float(E.best_threshold(sweep).first()["threshold"])
    metrics, cal_test = side_by_side(
        spark, lambda: E.classification_metrics(cal, threshold, score="prob_cal"),
        lambda: E.classification_metrics(test, threshold, score="prob_cal")
        .withColumn("model", F.lit(f"calibrated ({method})")))
    metric_rows = metrics.collect()
    brier = {r["method"]: r["brier_score"] for r in cal_table.collect()}
    meta = default_cancellation_meta(threshold, version)
    meta.update({
        "model_name": "cancellation_gbt_calibrated",
        "trained_on": _dt.date.today().isoformat(),
        "positive_class": "Canceled",
        "n_train_rows": n_train,
        "params": {**M.BOOSTED_CLASSIFIER, **gbt_params},
        "calibration_method": method,
        "brier_uncalibrated": brier["uncalibrated"], "brier_calibrated": brier[method],
        "dummy_baseline": {f"{r['split']}_accuracy": float(r["accuracy"]) for r in dummy},
        "top_features": [(r["feature"], r["importance"]) for r in feature_importance(model, top=10).collect()],
        "features_required": FEATURES_REQUIRED,
        "metrics": {r["split"]: {k: float(r[k]) for k in
                                 ("accuracy", "precision", "recall", "f1", "roc_auc", "brier")}
                    for r in metric_rows},
    })
    return {"model": model, "pipeline": calibrated_pipeline(model, calibrator, method, threshold),
            "calibrator": calibrator, "method": method, "threshold": threshold,
            "calibration_table": cal_table, "sweep": sweep, "scored": cal,
            "metrics": metrics, "raw_vs_calibrated": raw_test.unionByName(cal_test),
            "band_distribution": E.risk_band_distribution(cal, "prob_cal"), "meta": meta}


def finalize_price(price_split: DataFrame, version: str = "1.0.0", **gbt_params) -> dict:
    """Boosted regressor: raw vs log1p target chosen on validation RMSE,
    then metrics on every split in price units. The baseline is measured beside the fits."""
    target = "avg_price_per_room"

    def baseline() -> tuple:
        dummy = M.fit_dummy_regressor(price_split)
        return dummy.value, E.regression_metrics(dummy.transform(price_split).select(
            "split", F.col(target).alias("actual"), F.col("prediction").alias("predicted"))).collect()
    (choice, models), (mean, base), n_train = side_by_side(
        price_split.sparkSession,
        lambda: M.compare_targets(price_split, lambda d, t: M.fit_boosted_regressor(d, t, **gbt_params)),
        baseline, lambda: price_split.where("split = 'train'").count())
    transform = choice.where("chosen").first()["target"]
    model = models[transform]
    pred = M.predict_price(model, M.over_cores(price_split), transform).select(
        "Booking_ID", "split", F.col("avg_price_per_room").alias("actual"),
        F.col("predicted_price").alias("predicted"))
    pred = written(pred, "price-predictions")
    metrics = E.regression_metrics(pred)
    meta = {
        "model_name": "room_price_gbt", "version": version,
        "trained_on": _dt.date.today().isoformat(),
        "target_transformation": transform,
        "n_train_rows": n_train,
        "dummy_baseline": {"train_mean": mean,
                           **{f"{r['split']}_rmse": float(r["rmse"]) for r in base}},
        "target_comparison": {f"{r['target']}_rmse": r["val_rmse"] for r in choice.collect()},
        "top_features": [(r["feature"], r["importance"]) for r in feature_importance(model, top=10).collect()],
        "params": {**M.BOOSTED_REGRESSOR, **gbt_params},
        "features_required": [f for f in FEATURES_REQUIRED if f != "avg_price_per_room"],
        "metrics": {r["split"]: {k: float(r[k]) for k in ("r2", "mae", "rmse")}
                    for r in metrics.collect()},
    }
    return {"model": model, "transform": transform, "target_comparison": choice,
            "predictions": pred, "metrics": metrics, "meta": meta}


def feature_importance(model, clean: bool = True, top: int | None = None) -> DataFrame:
    """(rank, feature, importance) of a fitted tree pipeline, importance
    descending (ties by name; the importances sum to 1); ``top`` keeps the first."""
    from innsight.operators.features import clean_feature_name
    est = model.stages[-1]
    ranked = sorted(zip(M.feature_names(model), est.featureImportances.toArray()), key=lambda r: (-r[1], r[0]))
    from pyspark.sql import SparkSession
    spark = SparkSession.active()
    df = spark.createDataFrame([(i + 1, n, float(v)) for i, (n, v) in enumerate(ranked[:top])],
                               "rank int, feature string, importance double")
    if clean:
        df = df.withColumn("feature", clean_feature_name(F.col("feature")))
    return df.orderBy("rank")


def classification_leaderboard(scored: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """One row per model, sorted by test ROC AUC: accuracy, F1 and ROC AUC on
    train, val and test, precision and recall on test. scored: (split, label, prob) by model."""
    parts = [E.classification_metrics(d.select("split", "label", "prob"), threshold)
             .withColumn("model", F.lit(n)) for n, d in scored.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    pick = lambda s, m: F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
    wide = long.groupBy("model").agg(
        *[pick(s, m) for m in ("accuracy", "f1", "roc_auc") for s in ("train", "val", "test")],
        pick("test", "precision"), pick("test", "recall"))
    return wide.orderBy(F.desc_nulls_last("test_roc_auc"), "model")


def regression_leaderboards(metrics: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(validation table sorted by RMSE, train and test table sorted by test
    RMSE). metrics: ``regression_metrics`` per split, by model."""
    parts = [d.withColumn("model", F.lit(n)) for n, d in metrics.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    val = (long.where("split = 'val'").select("model", "r2", "mae", "rmse")
           .orderBy("rmse", "model"))
    pick = lambda s, m: F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
    both = long.groupBy("model").agg(*[pick(s, m) for s in ("train", "test") for m in ("r2", "mae", "rmse")])
    return val, both.orderBy("test_rmse", "model")


def final_price_table(price_split: DataFrame, fin: dict) -> DataFrame:
    """The mean baseline on test, then the production model on train, val and test."""
    dummy = M.fit_dummy_regressor(price_split).transform(price_split.where("split = 'test'")).select(
        "split", F.col("avg_price_per_room").alias("actual"), F.col("prediction").alias("predicted"))
    rows = E.regression_metrics(dummy).withColumn("model", F.lit("mean baseline")).unionByName(
        fin["metrics"].withColumn("model", F.lit(f"boosted ({fin['transform']})")))
    order = F.array_position(F.array(*[F.lit(s) for s in ("train", "val", "test")]), F.col("split"))
    return rows.select("model", "split", "r2", "mae", "rmse").orderBy(
        F.desc(F.col("model") == "mean baseline"), order)
