"""Registered queries that fit models.

Fits are not expressible in SQL, so most of these have no oracle (rows-only
check) and tests assert metric floors and invariants instead; results that do
not depend on the fit have one. The models are the study's (500 and 300
trees). Each is trained once per application and shared by the queries that
need it; a query that needs several trains them side by side.

The two random searches (30 draws x 5 folds of up to 500 trees) grow their fits
side by side and keep a ledger of finished draws in the shared folder.
"""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from innsight.operators import evaluate as E
from innsight.operators import finalize as FZ
from innsight.operators import models as M
from innsight.operators.audit import as_requests
from innsight.operators.scoring import Scorer, flatten_response
from innsight.plans.evaluate_queries import _metrics_sql
from innsight.plans.prepared import price_split_table, priced_table, scored_table, split_table
from innsight.plans.registry import register
from innsight.plans.sqltext import CLEAN_CTE, PRICE_CTE, SCORED_CTE
from innsight.session import scratch_path, side_by_side
from innsight.sources.bookings import bookings_table
from innsight.sources.tables import (latest_run, load_model, load_models, save_production,
                                    write_run_record)

_lock = threading.Lock()
_locks: dict = {}
_cache: dict = {}


def _once(spark, sf_dir, name, build):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _lock:
        own = _locks.setdefault(key, threading.RLock())
    with own:
        if key not in _cache:
            _cache[key] = build()
    return _cache[key]


def _splits(spark, sf_dir):
    return split_table(spark, sf_dir)


def _prices(spark, sf_dir):
    return price_split_table(spark, sf_dir)


def _reg_metrics(model, df, transform):
    pred = M.predict_price(model, df, transform).select(
        "split", F.col("avg_price_per_room").alias("actual"), F.col("predicted_price").alias("predicted"))
    return E.regression_metrics(pred)


def clf_final(spark, sf_dir):
    return _once(spark, sf_dir, "clf_final", lambda: FZ.finalize_cancellation(
        _splits(spark, sf_dir)))


def reg_final(spark, sf_dir):
    return _once(spark, sf_dir, "reg_final", lambda: FZ.finalize_price(
        _prices(spark, sf_dir)))


def both_final(spark, sf_dir) -> list:
    """The production classifier and regressor."""
    return side_by_side(spark, lambda: clf_final(spark, sf_dir), lambda: reg_final(spark, sf_dir))


def logistic_model(spark, sf_dir):
    return _once(spark, sf_dir, "logistic", lambda: M.fit_logistic(_splits(spark, sf_dir)))


def clf_sweep(spark, sf_dir):
    return _once(spark, sf_dir, "clf_sweep", lambda: M.depth_sweep_classifier(_splits(spark, sf_dir)))


def reg_sweep(spark, sf_dir):
    return _once(spark, sf_dir, "reg_sweep", lambda: M.depth_sweep_regressor(_prices(spark, sf_dir)))


def tree_classifier(spark, sf_dir):
    return _once(spark, sf_dir, "tree_clf", lambda: M.fit_tree_classifier(
        _splits(spark, sf_dir), M.best_depth(clf_sweep(spark, sf_dir), "val_f1")))


def tree_regressor(spark, sf_dir):
    return _once(spark, sf_dir, "tree_reg", lambda: M.fit_tree_regressor(
        _prices(spark, sf_dir), M.best_depth(reg_sweep(spark, sf_dir), "val_rmse", maximize=False)))


def ridge_model(spark, sf_dir):
    return _once(spark, sf_dir, "ridge", lambda: M.fit_ridge(_prices(spark, sf_dir), 10.0, "log1p"))


# --------------------------------------------------------------------------
# classifiers
# --------------------------------------------------------------------------

@register("fit_logistic")
def q_fit_logistic(spark, sf_dir):
    s = _splits(spark, sf_dir)
    return E.classification_metrics(M.predict_classifier(logistic_model(spark, sf_dir), s), 0.5)


@register("select_from_model")
def q_select_from_model(spark, sf_dir):
    """Features kept by the quick boosted model (importance >= mean)."""
    return q_selected_features_report(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.sum(F.col("selected").cast("int")).alias("n_selected"),
        F.avg("importance").alias("threshold"))


@register("selected_features_report")
def q_selected_features_report(spark, sf_dir):
    m = logistic_model(spark, sf_dir)
    sel = next(s for s in m.stages if isinstance(s, M.ImportanceSelectorModel))
    onehot = next(s for s in m.stages if hasattr(s, "feature_names"))
    scaler = next(s for s in m.stages if hasattr(s, "means"))
    names = list(scaler.getOrDefault(scaler.outputCols)) + onehot.feature_names()
    keep = set(sel.getOrDefault(sel.indices))
    imp = sel.getOrDefault(sel.importances)
    rows = [(n, i in keep, float(imp[i])) for i, n in enumerate(names)]
    rows.sort(key=lambda r: (not r[1], -r[2], r[0]))
    return spark.createDataFrame(rows, "feature string, selected boolean, importance double")


@register("depth_sweep_classifier")
def q_depth_sweep_classifier(spark, sf_dir):
    return clf_sweep(spark, sf_dir)


@register("fit_tree_classifier")
def q_fit_tree_classifier(spark, sf_dir):
    s = _splits(spark, sf_dir)
    return E.classification_metrics(M.predict_classifier(tree_classifier(spark, sf_dir), s), 0.5)


@register("fit_boosted_classifier")
def q_fit_boosted_classifier(spark, sf_dir):
    return E.classification_metrics(clf_final(spark, sf_dir)["scored"], 0.5)


@register("class_weights_boosted", SCORED_CTE + """
, w AS (SELECT CAST(FLOOR(CAST(SUM(1 - label) AS DOUBLE) / SUM(label)) AS DOUBLE) AS r
        FROM splits WHERE split = 'train')
SELECT label, CASE WHEN label = 1 THEN r ELSE CAST(1.0 AS DOUBLE) END AS weight, COUNT(*) AS count
FROM splits, w WHERE split = 'train' GROUP BY ALL""", ["weight"])
def q_class_weights_boosted(spark, sf_dir):
    """The positive-class row weight int(neg / pos) used by boosting."""
    return M.positive_weight(_splits(spark, sf_dir)).groupBy("label", "weight").count()


@register("classification_leaderboard")
def q_classification_leaderboard(spark, sf_dir):
    """One row per model with its metrics on every split, best test ROC AUC first."""
    s = _splits(spark, sf_dir)
    logistic, tree, boosted = side_by_side(spark, *[lambda m=m: m(spark, sf_dir) for m in (
        logistic_model, tree_classifier, clf_final)])
    return FZ.classification_leaderboard({
        "dummy": M.fit_dummy_classifier(s).transform(s),
        "logistic": M.predict_classifier(logistic, s),
        "tree": M.predict_classifier(tree, s),
        "boosted": boosted["scored"],
    })


@register("classification_leaderboard_rules", SCORED_CTE + _metrics_sql("scored", "prob", "0.5", "m") + """
, d AS (SELECT CAST(label AS DOUBLE) AS p FROM splits WHERE split = 'train' GROUP BY label
        ORDER BY COUNT(*) DESC, label LIMIT 1),
  ds AS (SELECT split, label, (SELECT p FROM d) AS prob FROM splits)""" + _metrics_sql("ds", "prob", "0.5", "n") + """
, a AS (SELECT 'lead_time' AS model, * FROM m UNION ALL SELECT 'dummy', * FROM n)
SELECT model, """ + ", ".join(
    f"MAX({m}) FILTER (split = '{s}') AS {s}_{m}" for m in ("accuracy", "f1", "roc_auc")
    for s in ("train", "val", "test")) + """,
  MAX(precision) FILTER (split = 'test') AS test_precision, MAX(recall) FILTER (split = 'test') AS test_recall
FROM a GROUP BY model""", [f"{s}_{m}" for m in ("accuracy", "f1", "roc_auc") for s in ("train", "val", "test")]
          + ["test_precision", "test_recall"])
def q_classification_leaderboard_rules(spark, sf_dir):
    """The same table for two scores that need no fit, so that SQL can check it."""
    s = scored_table(spark, sf_dir)
    return FZ.classification_leaderboard({
        "dummy": M.fit_dummy_classifier(s).transform(s.drop("prob")), "lead_time": s})


@register("train_leaderboard_models")
def q_train_leaderboard_models(spark, sf_dir):
    """Every leaderboard model is fitted (a failing fit does not stop the
    others): its status and its validation metrics."""
    c, p = side_by_side(spark, lambda: _splits(spark, sf_dir), lambda: _prices(spark, sf_dir))
    scored = lambda d: E.classification_metrics(d.where("split = 'val'"), 0.5)
    fits = {"logistic": lambda: scored(M.predict_classifier(logistic_model(spark, sf_dir), c)),
            "tree": lambda: scored(M.predict_classifier(tree_classifier(spark, sf_dir), c)),
            "boosted": lambda: scored(clf_final(spark, sf_dir)["scored"]),
            "ridge": lambda: _reg_metrics(ridge_model(spark, sf_dir), p, "log1p").where("split = 'val'"),
            "tree_regressor": lambda: _reg_metrics(tree_regressor(spark, sf_dir), p, "log1p")
            .where("split = 'val'"),
            "boosted_regressor": lambda: reg_final(spark, sf_dir)["metrics"].where("split = 'val'")}
    names = ("accuracy", "f1", "roc_auc", "r2", "mae", "rmse")

    def row(name, fit):
        try:
            m = fit().first().asDict()
            return name, "fitted", None, *[m.get(k) for k in names]
        except Exception as e:  # noqa: BLE001 - recorded, the others continue
            return name, "failed", f"{type(e).__name__}: {e}"[:200], *[None] * len(names)
    rows = side_by_side(spark, *[lambda n=n, f=f: row(n, f) for n, f in fits.items()])
    return spark.createDataFrame(rows, "model string, status string, error string, "
                                 + ", ".join(f"val_{k} double" for k in names))


def clf_search(spark, sf_dir):
    return _once(spark, sf_dir, "clf_search", lambda: M.random_search_classifier(
        _splits(spark, sf_dir), ledger=scratch_path(spark, "search-classifier")))


@register("random_search_classifier")
def q_random_search_classifier(spark, sf_dir):
    """30 draws of nine parameters, stratified 5-fold ROC AUC: mean, spread and rank of every draw."""
    return clf_search(spark, sf_dir)


@register("search_results_top10")
def q_search_results_top10(spark, sf_dir):
    """The ten best draws (a top-k report)."""
    return M.search_results_top(clf_search(spark, sf_dir)).select(
        "rank", "config", "mean_roc_auc", "std_roc_auc", "maxIter", "maxDepth", "stepSize", "subsamplingRate")


@register("search_best_params")
def q_search_best_params(spark, sf_dir):
    """Parameters of the best draw and its cross-validated ROC AUC."""
    return M.best_params_table(clf_search(spark, sf_dir))


# --------------------------------------------------------------------------
# calibration and production
# --------------------------------------------------------------------------

@register("calibration_table")
def q_calibration_table(spark, sf_dir):
    return clf_final(spark, sf_dir)["calibration_table"]


@register("calibrate_sigmoid")
def q_calibrate_sigmoid(spark, sf_dir):
    """Platt scaling of the boosted model's validation scores."""
    scored = clf_final(spark, sf_dir)["scored"].where("split = 'val'")
    m = E.fit_sigmoid(scored)
    brier = E.apply_calibrator(scored, m, "sigmoid", "prob", "p").agg(
        F.avg(F.pow(F.col("p") - F.col("label"), 2))).first()[0]
    return spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]), float(brier))],
                                 "intercept double, coefficient double, brier double")


@register("raw_vs_calibrated_model")
def q_raw_vs_calibrated_model(spark, sf_dir):
    return clf_final(spark, sf_dir)["raw_vs_calibrated"]


@register("risk_band_distribution_model")
def q_risk_band_distribution_model(spark, sf_dir):
    return clf_final(spark, sf_dir)["band_distribution"]


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Importance of every feature, most important first."""
    return FZ.feature_importance(clf_final(spark, sf_dir)["model"])


@register("feature_importance_price")
def q_feature_importance_price(spark, sf_dir):
    """The 20 most important features of the price model (a top-k report)."""
    return FZ.feature_importance(reg_final(spark, sf_dir)["model"], top=20)


# --------------------------------------------------------------------------
# regressors
# --------------------------------------------------------------------------

@register("fit_ridge")
def q_fit_ridge(spark, sf_dir):
    return _reg_metrics(ridge_model(spark, sf_dir), _prices(spark, sf_dir), "log1p")


@register("depth_sweep_regressor")
def q_depth_sweep_regressor(spark, sf_dir):
    return reg_sweep(spark, sf_dir)


@register("fit_tree_regressor")
def q_fit_tree_regressor(spark, sf_dir):
    return _reg_metrics(tree_regressor(spark, sf_dir), _prices(spark, sf_dir), "log1p")


@register("fit_boosted_regressor")
def q_fit_boosted_regressor(spark, sf_dir):
    return reg_final(spark, sf_dir)["metrics"]


@register("random_search_regressor")
def q_random_search_regressor(spark, sf_dir):
    """30 draws, plain 5-fold RMSE in price units: mean, spread and rank of every draw."""
    return M.random_search_regressor(_prices(spark, sf_dir), ledger=scratch_path(spark, "search-regressor"))


@register("compare_targets")
def q_compare_targets(spark, sf_dir):
    """Raw vs log1p target for ridge (alpha = 1), chosen by validation RMSE."""
    return M.compare_targets(_prices(spark, sf_dir), lambda d, t: M.fit_ridge(d, 1.0, t))[0]


@register("compare_targets_boosted")
def q_compare_targets_boosted(spark, sf_dir):
    """Raw vs log1p target for the boosted regressor (the production choice)."""
    return reg_final(spark, sf_dir)["target_comparison"]


def _regressor_metrics(spark, sf_dir):
    p = _prices(spark, sf_dir)
    dummy = M.fit_dummy_regressor(p).transform(p).select(
        "split", F.col("avg_price_per_room").alias("actual"), F.col("prediction").alias("predicted"))
    ridge, tree, boosted = side_by_side(spark, *[lambda m=m: m(spark, sf_dir) for m in (
        ridge_model, tree_regressor, reg_final)])
    return {"dummy": E.regression_metrics(dummy),
            "ridge": _reg_metrics(ridge, p, "log1p"),
            "tree": _reg_metrics(tree, p, "log1p"),
            "boosted": boosted["metrics"]}


@register("regression_leaderboard")
def q_regression_leaderboard(spark, sf_dir):
    """Train and test metrics of every model, lowest test RMSE first."""
    return FZ.regression_leaderboards(_regressor_metrics(spark, sf_dir))[1]


@register("regression_leaderboard_val")
def q_regression_leaderboard_val(spark, sf_dir):
    """Validation metrics of every model, lowest RMSE first."""
    return FZ.regression_leaderboards(_regressor_metrics(spark, sf_dir))[0]


@register("regression_final_table")
def q_regression_final_table(spark, sf_dir):
    """The mean baseline on test and the production model on every split."""
    return FZ.final_price_table(_prices(spark, sf_dir), reg_final(spark, sf_dir))


@register("regression_leaderboard_rules", PRICE_CTE + """
, dm AS (SELECT AVG(avg_price_per_room) AS p FROM psplits WHERE split = 'train'),
  u AS (SELECT 'segment_mean' AS model, split, actual, predicted FROM priced
        UNION ALL SELECT 'dummy', split, actual, (SELECT p FROM dm) FROM priced),
  m AS (SELECT model, split, 1 - SUM(POWER(actual - predicted, 2)) / (VAR_POP(actual) * COUNT(actual)) AS r2,
          AVG(ABS(actual - predicted)) AS mae, SQRT(AVG(POWER(actual - predicted, 2))) AS rmse
        FROM u GROUP BY model, split)
SELECT model, """ + ", ".join(f"MAX({k}) FILTER (split = '{s}') AS {s}_{k}" for s in ("train", "test")
                              for k in ("r2", "mae", "rmse")) + " FROM m GROUP BY model",
          [f"{s}_{k}" for s in ("train", "test") for k in ("r2", "mae", "rmse")])
def q_regression_leaderboard_rules(spark, sf_dir):
    """The same table for two predictions that need no fit, so that SQL can check it."""
    p = priced_table(spark, sf_dir)
    mean = M.fit_dummy_regressor(p, "actual").value
    return FZ.regression_leaderboards({
        "segment_mean": E.regression_metrics(p),
        "dummy": E.regression_metrics(p.withColumn("predicted", F.lit(mean)))})[1]


# --------------------------------------------------------------------------
# persistence, run records and scoring
# --------------------------------------------------------------------------

def saved_runs(spark, sf_dir) -> tuple[str, str, str]:
    """(folder of run records, classifier name, regressor name): both
    production models saved as units, with the records that describe them."""
    def build():
        runs = scratch_path(spark, "runs")
        names = []
        for fin, kind in zip(both_final(spark, sf_dir), ("classifier", "regressor")):
            path = save_production(fin, scratch_path(spark, f"models/{kind}"))
            write_run_record(spark, _run_record(fin, path, kind), runs)
            names.append(fin["meta"]["model_name"])
        return runs, *names
    return _once(spark, sf_dir, "saved_runs", build)


def loaded_scorer(spark, sf_dir) -> Scorer:
    """What production scores with: both models read back from their run records."""
    return _once(spark, sf_dir, "loaded_scorer", lambda: Scorer.load(spark, *saved_runs(spark, sf_dir)))


@register("save_model", CLEAN_CTE + """
SELECT COUNT(*) AS n_rows, CAST(0.0 AS DOUBLE) AS max_abs_diff, CAST(0 AS BIGINT) AS n_labels_differ
FROM bookings""", ["max_abs_diff"])
def q_save_model(spark, sf_dir):
    """Every booking scored in memory and by the saved unit of pipeline,
    calibrator and threshold: no probability or label differs."""
    req = as_requests(bookings_table(spark, sf_dir))
    pick = lambda scorer, s: scorer.score(req).select(
        "request_id", F.col("cancellation_probability").alias(f"p{s}"), F.col("cancellation_label").alias(f"l{s}"))
    a, b = pick(production_scorer(spark, sf_dir), 0), pick(loaded_scorer(spark, sf_dir), 1)
    return a.join(b, "request_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("p0") - F.col("p1"))).alias("max_abs_diff"),
        F.sum((F.col("l0") != F.col("l1")).cast("bigint")).alias("n_labels_differ"))


@register("calibrated_pipeline", CLEAN_CTE + """
SELECT 5 AS n_stages, 'CalibratorModel' AS last_stage, COUNT(*) AS n_rows, CAST(0.0 AS DOUBLE) AS max_abs_diff,
  CAST(0 AS BIGINT) AS n_labels_differ
FROM bookings""", ["max_abs_diff"])
def q_calibrated_pipeline(spark, sf_dir):
    """The saved pipeline, calibrator and threshold as one stage list: loaded and applied to every
    booking, it gives what the separate calibrator and threshold give."""
    fin = clf_final(spark, sf_dir)
    path = latest_run(spark, *saved_runs(spark, sf_dir)[:2])["model_path"] + "/pipeline"
    loaded = load_model(spark, path)
    req = as_requests(bookings_table(spark, sf_dir)).withColumns({
        "avg_price_per_room": F.col("current_room_price"),
        "is_zero_adults": (F.col("no_of_adults") == 0).cast("int"),
        "is_zero_nights": ((F.col("no_of_weekend_nights") + F.col("no_of_week_nights")) == 0).cast("int")})
    raw = M.predict_classifier(fin["model"], req).select("Booking_ID", "prob")
    apart = E.apply_calibrator(raw, fin["calibrator"], fin["method"], "prob", "p0").withColumn(
        "l0", (F.col("p0") >= fin["threshold"]).cast("int"))
    whole = loaded.transform(req).select("Booking_ID", "prob_cal", "predicted_label")
    # model stages: features, scaler, one-hot, assembler, trees; the calibrator is the sixth
    return apart.join(whole, "Booking_ID").agg(
        F.lit(len(loaded.stages) - 1).alias("n_stages"), F.lit(type(loaded.stages[-1]).__name__).alias("last_stage"),
        F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("p0") - F.col("prob_cal"))).alias("max_abs_diff"),
        F.sum((F.col("l0") != F.col("predicted_label")).cast("bigint")).alias("n_labels_differ"))


@register("load_model", """
SELECT * FROM (VALUES ('cancellation', 'BoostedTreesModel', true, true),
                      ('price', 'BoostedTreesModel', true, true),
                      ('missing', NULL, false, false)) AS t(model, estimator, cached, loaded)""")
def q_load_model(spark, sf_dir):
    """Both production models loaded once (cached per session); a missing
    model is reported, not fatal."""
    runs, clf, reg = saved_runs(spark, sf_dir)
    paths = {"cancellation": latest_run(spark, runs, clf)["model_path"] + "/pipeline",
             "price": latest_run(spark, runs, reg)["model_path"] + "/pipeline",
             "missing": scratch_path(spark, "models/none")}
    models, errors = load_models(spark, paths)
    rows = []
    for name in paths:
        m = models.get(name)
        err = next((e for e in errors if e.startswith(name + ":")), None)
        fitted = next((s for s in reversed(m.stages) if hasattr(s, "featureImportances")), None) if m else None
        rows.append((name, type(fitted).__name__ if fitted else None,
                     bool(m) and load_model(spark, paths[name]) is m, err is None))
    return spark.createDataFrame(rows, "model string, estimator string, cached boolean, loaded boolean")


def _run_record(fin: dict, path: str, kind: str) -> dict:
    meta = fin["meta"]
    metrics = [(s, k, float(v)) for s, d in meta["metrics"].items() for k, v in d.items()]
    bands = None
    if kind == "classifier":
        rb = meta["risk_bands"]
        bands = [("low", None, rb["low"]["upper_exclusive"], rb["low"]["description"]),
                 ("medium", rb["medium"]["lower_inclusive"], rb["medium"]["upper_exclusive"],
                  rb["medium"]["description"]),
                 ("high", rb["high"]["lower_inclusive"], None, rb["high"]["description"])]
    fields = ("model_name", "version", "trained_on", "positive_class", "n_train_rows", "params",
              "features_required", "threshold", "calibration_method", "brier_uncalibrated",
              "brier_calibrated", "dummy_baseline", "target_transformation", "target_comparison", "top_features")
    return {**{f: meta.get(f) for f in fields}, "kind": kind, "model_path": path,
            "risk_bands": bands, "metrics": metrics}


@register("write_run_record")
def q_write_run_record(spark, sf_dir):
    """One nested run record per production model, appended and read back."""
    return spark.read.parquet(saved_runs(spark, sf_dir)[0]).select(
        "model_name", "version", "kind", "trained_on", "positive_class", "n_train_rows", "threshold",
        "calibration_method", "brier_uncalibrated", "brier_calibrated", "target_transformation",
        F.map_entries("dummy_baseline").alias("dummy_baseline"),
        F.map_entries("target_comparison").alias("target_comparison"),
        "top_features", F.size("metrics").alias("n_metrics"),
        F.size("features_required").alias("n_features"),
        F.get_json_object("params_json", "$.maxIter").alias("trees"))


def production_scorer(spark, sf_dir) -> Scorer:
    fin_c, fin_r = both_final(spark, sf_dir)
    return Scorer(fin_c["model"], fin_r["model"], fin_c["meta"], fin_r["meta"],
                  fin_c["calibrator"], fin_c["method"])


@register("score_bookings")
def q_score_bookings(spark, sf_dir):
    """Every booking scored by both saved production models and the rules."""
    scorer = loaded_scorer(spark, sf_dir)
    return flatten_response(scorer.score(as_requests(M.over_cores(bookings_table(spark, sf_dir)))))


@register("score_stream")
def q_score_stream(spark, sf_dir):
    """The same scoring as a stream over JSON request files; returns the
    accepted scored rows (rejected rows go to the dead-letter table)."""
    from innsight.streaming.score_stream import run_score_stream, write_requests
    b = bookings_table(spark, sf_dir)
    req = as_requests(M.over_cores(b))
    src = write_requests(req, scratch_path(spark, "stream-in"))
    min_year = b.agg(F.min("arrival_year")).first()[0]
    acc, _ = run_score_stream(spark, src, production_scorer(spark, sf_dir),
                              scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt"),
                              min_arrival_year=min_year)
    return flatten_response(acc)



@register("score_stream_dead_letters", """
SELECT error, COUNT(*) AS n_lines, CAST(0 AS BIGINT) AS n_changed FROM (
  SELECT CASE WHEN lead_time % 97 = 0 THEN 'malformed JSON' ELSE 'lead_time: not of type bigint' END AS error
  FROM bookings WHERE lead_time % 97 IN (0, 1)) GROUP BY error""")
def q_score_stream_dead_letters(spark, sf_dir):
    """Every booking sent as a line; lines are cut in the middle or carry a word for a number by a rule on
    lead_time. Each such line is found in the dead letters, character for character, with its error."""
    from innsight.streaming.score_stream import REQUEST_SCHEMA, run_score_stream
    b = bookings_table(spark, sf_dir)
    names = [f.name for f in REQUEST_SCHEMA.fields]
    line = F.to_json(F.struct(*names))
    rest = F.col("lead_time") % 97
    lines = as_requests(b).select("Booking_ID", "lead_time", line.alias("line")).select(
        rest.isin(0, 1).alias("broken"),
        F.when(rest == 0, F.substr("line", F.lit(1), F.floor(F.length("line") / 2).cast("int")))
        .when(rest == 1, F.regexp_replace("line", r'"lead_time":\d+', '"lead_time":"many"'))
        .otherwise(F.col("line")).alias("value"))
    src = scratch_path(spark, "lines-in")
    lines.select("value").write.text(src)
    year = b.agg(F.min("arrival_year")).first()[0]
    _, dead = run_score_stream(spark, src, production_scorer(spark, sf_dir), scratch_path(spark, "lines-out"),
                               scratch_path(spark, "lines-ckpt"), min_arrival_year=year)
    wanted = ["malformed JSON", "lead_time: not of type bigint"]
    found = dead.select("raw", F.explode("errors").alias("error")).where(F.col("error").isin(wanted))
    sent = lines.where("broken").groupBy(F.col("value").alias("raw")).agg(F.count(F.lit(1)).alias("n_sent"))
    got = found.groupBy("raw", "error").agg(F.count(F.lit(1)).alias("n"))
    return got.join(sent, "raw", "left").groupBy("error").agg(
        F.sum("n").alias("n_lines"),
        F.sum(F.when(F.col("n_sent").eqNullSafe(F.col("n")), 0).otherwise(F.col("n"))).alias("n_changed"))
