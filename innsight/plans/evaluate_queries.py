"""Registered queries for evaluation, calibration and thresholds.

They run on a deterministic score (a fixed function of lead time) so that
every metric can be checked against SQL; the same operators take a fitted
model's probabilities unchanged (see model_queries).
"""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from innsight.operators import evaluate as E
from innsight.plans.prepared import priced_table, scored_table
from innsight.plans.registry import register
from innsight.plans.sqltext import PRICE_CTE, SCORED_CTE

METRICS = ["accuracy", "precision", "recall", "f1", "brier", "roc_auc"]
SWEEP = E.sweep_thresholds()
CHOSEN_THRESHOLD = 0.34  # fixed value: the study's production threshold


def _cm_sql(src: str, prob: str, t: str, by: str = "split") -> str:
    """Confusion counts and Brier per group."""
    return (f"SELECT {by}, SUM(CASE WHEN {prob} >= {t} AND label = 1 THEN 1 ELSE 0 END) AS tp, "
            f"SUM(CASE WHEN {prob} >= {t} AND label = 0 THEN 1 ELSE 0 END) AS fp, "
            f"SUM(CASE WHEN {prob} < {t} AND label = 1 THEN 1 ELSE 0 END) AS fn, "
            f"SUM(CASE WHEN {prob} < {t} AND label = 0 THEN 1 ELSE 0 END) AS tn, "
            f"AVG(POWER({prob} - label, 2)) AS brier FROM {src} GROUP BY {by}")


_METRIC_SQL = ("CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy, "
               "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision, "
               "COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS recall, "
               "COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1")


def _auc_sql(src: str, prob: str, name: str, by: str = "split") -> str:
    return f"""
, {name}_v AS (SELECT {by}, {prob} AS p, COUNT(*) AS n, SUM(label) AS pos FROM {src} GROUP BY {by}, {prob}),
  {name}_r AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY {by} ORDER BY p
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS ar FROM {name}_v),
  {name} AS (SELECT {by}, (SUM(ar * pos) - CAST(SUM(pos) AS DOUBLE) * (SUM(pos) + 1) / 2)
                          / (CAST(SUM(pos) AS DOUBLE) * (SUM(n) - SUM(pos))) AS roc_auc
             FROM {name}_r GROUP BY {by})"""


def _metrics_sql(src: str, prob: str, t: str, name: str) -> str:
    return (_auc_sql(src, prob, f"{name}_auc") +
            f"\n, {name}_cm AS ({_cm_sql(src, prob, t)}),\n"
            f"  {name} AS (SELECT c.split, {_METRIC_SQL}, brier, a.roc_auc FROM {name}_cm c "
            f"LEFT JOIN {name}_auc a ON c.split = a.split)")


# isotonic fit on validation scores (max-min block means), then every row's
# calibrated score by linear interpolation between fitted points, clipped
ISO_CTE = SCORED_CTE + """
, iv AS (SELECT prob AS x, CAST(SUM(label) AS DOUBLE) AS sy, CAST(COUNT(*) AS DOUBLE) AS c
         FROM scored WHERE split = 'val' GROUP BY prob),
  ip AS (SELECT x, sy, c, ROW_NUMBER() OVER (ORDER BY x) AS i,
                SUM(sy) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS cy,
                SUM(c) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS cc FROM iv),
  blk AS (SELECT a.i AS j, b.i AS k, (b.cy - (a.cy - a.sy)) / (b.cc - (a.cc - a.c)) AS av
          FROM ip a JOIN ip b ON a.i <= b.i),
  mn AS (SELECT p.i, blk.j, MIN(blk.av) AS m FROM ip p JOIN blk ON blk.j <= p.i AND blk.k >= p.i
         GROUP BY p.i, blk.j),
  iso AS (SELECT p.x, MAX(mn.m) AS fx FROM mn JOIN ip p ON p.i = mn.i GROUP BY p.x),
  isoi AS (SELECT x, fx, LEAD(x) OVER (ORDER BY x) AS x2, LEAD(fx) OVER (ORDER BY x) AS f2 FROM iso),
  ends AS (SELECT MIN(x) AS xmin, MAX(x) AS xmax, arg_min(fx, x) AS fmin, arg_max(fx, x) AS fmax FROM iso),
  cal AS (SELECT s.*, LEAST(1.0, GREATEST(0.0,
            CASE WHEN s.prob <= e.xmin THEN e.fmin WHEN s.prob >= e.xmax THEN e.fmax
                 ELSE (SELECT CASE WHEN i.x = s.prob THEN i.fx
                                   ELSE i.fx + (i.f2 - i.fx) * (s.prob - i.x) / (i.x2 - i.x) END
                       FROM isoi i WHERE i.x <= s.prob AND i.x2 > s.prob) END)) AS prob_cal
          FROM scored s, ends e),
  th AS (SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(5, 85) AS t(i)),
  sw AS (SELECT threshold,
           SUM(CASE WHEN prob_cal >= threshold AND label = 1 THEN 1 ELSE 0 END) AS tp,
           SUM(CASE WHEN prob_cal >= threshold AND label = 0 THEN 1 ELSE 0 END) AS fp,
           SUM(CASE WHEN prob_cal < threshold AND label = 1 THEN 1 ELSE 0 END) AS fn,
           SUM(CASE WHEN prob_cal < threshold AND label = 0 THEN 1 ELSE 0 END) AS tn
         FROM th, cal WHERE split = 'val' GROUP BY threshold),
  sweep AS (SELECT threshold, """ + _METRIC_SQL + """ FROM sw),
  best AS (SELECT * FROM sweep ORDER BY round_even(f1, 4) DESC, threshold ASC LIMIT 1)"""


# --------------------------------------------------------------------------
# Spark side: the calibrated flow, computed once per application
# --------------------------------------------------------------------------

_lock = threading.Lock()
_flows: dict = {}


def calibrated_flow(spark, sf_dir):
    """(scored rows with prob_cal, chosen threshold, sweep table)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock:
        if key not in _flows:
            scored = scored_table(spark, sf_dir)
            iso = E.fit_isotonic(scored.where("split = 'val'"))
            cal = E.apply_calibrator(scored, iso, "isotonic", "prob", "prob_cal")
            sweep = E.threshold_sweep(cal.where("split = 'val'"), SWEEP, score="prob_cal")
            t = float(E.best_threshold(sweep).first()["threshold"])
            _flows[key] = (cal, t, sweep)
    return _flows[key]


def _metric_doubles():
    return ["accuracy", "precision", "recall", "f1", "brier", "roc_auc"]


@register("classification_metrics", SCORED_CTE + _metrics_sql("scored", "prob", "0.5", "m") +
          "\nSELECT * FROM m", _metric_doubles())
def q_classification_metrics(spark, sf_dir):
    return E.classification_metrics(scored_table(spark, sf_dir), 0.5)


@register("roc_auc", SCORED_CTE + _auc_sql("scored", "prob", "a") + "\nSELECT * FROM a", ["roc_auc"])
def q_roc_auc(spark, sf_dir):
    return E.roc_auc(scored_table(spark, sf_dir))


@register("confusion_matrix", SCORED_CTE + """
SELECT split, label AS actual, CAST(prob >= 0.5 AS INTEGER) AS predicted, COUNT(*) AS n
FROM scored GROUP BY split, label, CAST(prob >= 0.5 AS INTEGER)""")
def q_confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(scored_table(spark, sf_dir), 0.5)


_ROC_SQL = SCORED_CTE + """
, rv AS (SELECT split, prob AS threshold, COUNT(*) AS n, SUM(label) AS pos FROM scored GROUP BY split, prob),
  rc AS (SELECT *, SUM(n) OVER (PARTITION BY split ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS n_ge,
                SUM(pos) OVER (PARTITION BY split ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS pos_ge,
                SUM(n) OVER (PARTITION BY split) AS nn, SUM(pos) OVER (PARTITION BY split) AS pp FROM rv),
  roc AS (SELECT split, threshold, CAST(n_ge - pos_ge AS DOUBLE) / (nn - pp) AS fpr,
                 CAST(pos_ge AS DOUBLE) / pp AS tpr FROM rc)"""


@register("roc_curve", _ROC_SQL + "\nSELECT * FROM roc", ["threshold", "fpr", "tpr"])
def q_roc_curve(spark, sf_dir):
    return E.roc_curve(scored_table(spark, sf_dir))


@register("roc_operating_point", _ROC_SQL + f"""
, ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY split ORDER BY ABS(threshold - {CHOSEN_THRESHOLD}),
                                          threshold) AS rn FROM roc)
SELECT split, threshold, fpr, tpr FROM ranked WHERE rn = 1""", ["threshold", "fpr", "tpr"])
def q_roc_operating_point(spark, sf_dir):
    return E.roc_operating_point(E.roc_curve(scored_table(spark, sf_dir)), CHOSEN_THRESHOLD)


@register("brier_score", SCORED_CTE + """
SELECT split, AVG(POWER(prob - label, 2)) AS brier FROM scored GROUP BY split""", ["brier"])
def q_brier_score(spark, sf_dir):
    return E.brier_score(scored_table(spark, sf_dir))


@register("calibrate_isotonic", ISO_CTE + "\nSELECT x AS prob, fx AS calibrated FROM iso",
          ["prob", "calibrated"])
def q_calibrate_isotonic(spark, sf_dir):
    return E.isotonic_table(scored_table(spark, sf_dir).where("split = 'val'"))


@register("calibrated_predict", ISO_CTE + """
SELECT Booking_ID, split, prob, prob_cal, CAST(prob_cal >= (SELECT threshold FROM best) AS INTEGER) AS predicted
FROM cal""", ["prob", "prob_cal"])
def q_calibrated_predict(spark, sf_dir):
    cal, t, _ = calibrated_flow(spark, sf_dir)
    return cal.select("Booking_ID", "split", "prob", "prob_cal",
                      (F.col("prob_cal") >= F.lit(t)).cast("int").alias("predicted"))


_EDGES = [i * (1.0 / 10) for i in range(1, 10)]


@register("reliability_curve", SCORED_CTE + f"""
, rb AS (SELECT split, label, prob, CAST({' + '.join(f'CASE WHEN prob > {e!r} THEN 1 ELSE 0 END' for e in _EDGES)}
                AS BIGINT) AS bin FROM scored)
SELECT split, bin, AVG(prob) AS mean_predicted, AVG(CAST(label AS DOUBLE)) AS fraction_positive,
       COUNT(*) AS n FROM rb GROUP BY split, bin""", ["mean_predicted", "fraction_positive"])
def q_reliability_curve(spark, sf_dir):
    return E.reliability_curve(scored_table(spark, sf_dir))


@register("threshold_sweep", ISO_CTE + "\nSELECT * FROM sweep",
          ["threshold", "accuracy", "precision", "recall", "f1"])
def q_threshold_sweep(spark, sf_dir):
    return calibrated_flow(spark, sf_dir)[2]


@register("best_threshold", ISO_CTE + "\nSELECT * FROM best",
          ["threshold", "accuracy", "precision", "recall", "f1"])
def q_best_threshold(spark, sf_dir):
    return E.best_threshold(calibrated_flow(spark, sf_dir)[2])


@register("risk_band", ISO_CTE + """
SELECT Booking_ID, split, prob_cal,
       CASE WHEN prob_cal < 0.3 THEN 'low' WHEN prob_cal < 0.6 THEN 'medium' ELSE 'high' END AS risk_band
FROM cal""", ["prob_cal"])
def q_risk_band(spark, sf_dir):
    cal = calibrated_flow(spark, sf_dir)[0]
    return E.risk_bands(cal, "prob_cal").select("Booking_ID", "split", "prob_cal", "risk_band")


@register("risk_band_distribution", ISO_CTE + """
, bands AS (SELECT * FROM (VALUES ('val', 'low', 0), ('val', 'medium', 1), ('val', 'high', 2),
                                  ('test', 'low', 0), ('test', 'medium', 1), ('test', 'high', 2))
            AS t(split, band, band_order)),
  cb AS (SELECT split, CASE WHEN prob_cal < 0.3 THEN 'low' WHEN prob_cal < 0.6 THEN 'medium' ELSE 'high' END
                AS band, COUNT(*) AS n, SUM(label) AS c
         FROM cal WHERE split IN ('val', 'test') GROUP BY 1, 2),
  j AS (SELECT b.split, b.band, b.band_order, COALESCE(cb.n, 0) AS n, COALESCE(cb.c, 0) AS c
        FROM bands b LEFT JOIN cb ON b.split = cb.split AND b.band = cb.band)
SELECT split, band, CAST(band_order AS INTEGER) AS band_order, CAST(n AS BIGINT) AS n_bookings,
       n * 100.0 / GREATEST(SUM(n) OVER (PARTITION BY split), 1) AS pct_of_split,
       CAST(c AS BIGINT) AS n_canceled, c * 100.0 / GREATEST(n, 1) AS actual_cancel_rate
FROM j""", ["pct_of_split", "actual_cancel_rate"])
def q_risk_band_distribution(spark, sf_dir):
    cal = calibrated_flow(spark, sf_dir)[0]
    return E.risk_band_distribution(cal, "prob_cal")


def _overfit_sql() -> str:
    body = _metrics_sql("cal", "prob_cal", "(SELECT threshold FROM best)", "om")
    parts = [f"SELECT split, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM om" for m in METRICS]
    parts.append("SELECT 'train-val', 'f1_gap', (SELECT f1 FROM om WHERE split = 'train') - "
                 "(SELECT f1 FROM om WHERE split = 'val')")
    parts.append("SELECT 'val-test', 'f1_gap', (SELECT f1 FROM om WHERE split = 'val') - "
                 "(SELECT f1 FROM om WHERE split = 'test')")
    return ISO_CTE + body + "\n" + "\nUNION ALL ".join(parts)


@register("overfitting_summary", _overfit_sql(), ["value"])
def q_overfitting_summary(spark, sf_dir):
    cal, t, _ = calibrated_flow(spark, sf_dir)
    return E.overfitting_summary(E.classification_metrics(cal, t, score="prob_cal"))


def _raw_vs_cal_sql() -> str:
    raw = _metrics_sql("(SELECT * FROM cal WHERE split = 'test')", "prob", "0.5", "rw")
    cal = _metrics_sql("(SELECT * FROM cal WHERE split = 'test')", "prob_cal",
                       "(SELECT threshold FROM best)", "cw")
    cols = ", ".join(METRICS)
    return (ISO_CTE + raw + cal + f"\nSELECT 'raw' AS model, 0.5 AS threshold, {cols} FROM rw\n"
            f"UNION ALL SELECT 'calibrated (isotonic)', (SELECT threshold FROM best), {cols} FROM cw")


@register("raw_vs_calibrated", _raw_vs_cal_sql(), ["threshold"] + METRICS)
def q_raw_vs_calibrated(spark, sf_dir):
    cal, t, _ = calibrated_flow(spark, sf_dir)
    test = cal.where("split = 'test'")
    raw = E.classification_metrics(test, 0.5).withColumn("model", F.lit("raw")) \
        .withColumn("threshold", F.lit(0.5))
    c = E.classification_metrics(test, t, score="prob_cal") \
        .withColumn("model", F.lit("calibrated (isotonic)")).withColumn("threshold", F.lit(t))
    return raw.unionByName(c).select("model", "threshold", *METRICS)


# --------------------------------------------------------------------------
# regression
# --------------------------------------------------------------------------

@register("regression_metrics", PRICE_CTE + """
SELECT split, 1 - SUM(POWER(actual - predicted, 2)) / (VAR_POP(actual) * COUNT(actual)) AS r2,
       AVG(ABS(actual - predicted)) AS mae, SQRT(AVG(POWER(actual - predicted, 2))) AS rmse
FROM priced GROUP BY split""", ["r2", "mae", "rmse"])
def q_regression_metrics(spark, sf_dir):
    return E.regression_metrics(priced_table(spark, sf_dir))


@register("residual_summary", PRICE_CTE + """
SELECT split, AVG(actual - predicted) AS mean_residual, STDDEV_POP(actual - predicted) AS std_residual,
       COUNT(*) AS n FROM priced GROUP BY split""", ["mean_residual", "std_residual"])
def q_residual_summary(spark, sf_dir):
    return E.residual_summary(priced_table(spark, sf_dir))


@register("residual_histogram", PRICE_CTE + """
, hv AS (SELECT actual - predicted AS v FROM priced WHERE split = 'test'),
  hr AS (SELECT MIN(v) AS lo, MAX(v) AS hi, COUNT(*) AS n FROM hv),
  hb AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE LEAST(FLOOR((v - lo) * 60 / (hi - lo)), 59) END AS BIGINT) AS bin,
                lo, hi, n FROM hv, hr)
SELECT 'residual' AS series, bin, lo + bin * ((hi - lo) / 60) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 60) AS bin_hi,
       COUNT(*) AS count, CAST(COUNT(*) AS DOUBLE) / (n * ((hi - lo) / 60)) AS density
FROM hb GROUP BY bin, lo, hi, n""", ["bin_lo", "bin_hi", "density"])
def q_residual_histogram(spark, sf_dir):
    from innsight.operators.profile import histogram
    p = priced_table(spark, sf_dir).where("split = 'test'")
    return histogram(p, F.col("actual") - F.col("predicted"), 60, "residual")


@register("predicted_vs_actual", PRICE_CTE + """
, fr AS (SELECT split, LEAST(MIN(actual), MIN(predicted)) AS frame_min,
                GREATEST(MAX(actual), MAX(predicted)) AS frame_max FROM priced GROUP BY split)
SELECT p.Booking_ID, p.split, actual, predicted, frame_min, frame_max
FROM priced p JOIN fr ON p.split = fr.split""", ["actual", "predicted", "frame_min", "frame_max"])
def q_predicted_vs_actual_pairs(spark, sf_dir):
    """Every pair of actual and predicted price, with the frame of its split."""
    return E.predicted_actual_pairs(priced_table(spark, sf_dir))


@register("predicted_vs_actual_frame", PRICE_CTE + """
SELECT split, LEAST(MIN(actual), MIN(predicted)) AS frame_min, GREATEST(MAX(actual), MAX(predicted)) AS frame_max,
       CORR(actual, predicted) AS corr, COUNT(*) AS n FROM priced GROUP BY split""",
          ["frame_min", "frame_max", "corr"])
def q_predicted_vs_actual(spark, sf_dir):
    return E.predicted_vs_actual(priced_table(spark, sf_dir))


def _inv_norm_sql(p: str) -> str:
    """Same rational approximation of the normal quantile as the Spark side."""
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]

    def horner(coefs, x):
        acc = repr(coefs[0])
        for k in coefs[1:]:
            acc = f"({acc} * {x} + {k!r})"
        return acc

    ql = f"sqrt(-2 * ln({p}))"
    qh = f"sqrt(-2 * ln(1 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    low = f"({horner(c, ql)} / ({horner(d, ql)} * {ql} + 1))"
    high = f"(-{horner(c, qh)} / ({horner(d, qh)} * {qh} + 1))"
    mid = f"({horner(a, r)} * {q} / ({horner(b, r)} * {r} + 1))"
    return f"CASE WHEN {p} < 0.02425 THEN {low} WHEN {p} > 1 - 0.02425 THEN {high} ELSE {mid} END"


_QQ_SQL = PRICE_CTE + f"""
, qv AS (SELECT actual - predicted AS v, ROW_NUMBER() OVER (ORDER BY actual - predicted) AS i,
                COUNT(*) OVER () AS nn FROM priced WHERE split = 'test'),
  qm AS (SELECT v, i, CASE WHEN i = nn THEN POWER(0.5, 1.0 / nn) WHEN i = 1 THEN 1 - POWER(0.5, 1.0 / nn)
                     ELSE (i - 0.3175) / (nn + 0.365) END AS m FROM qv),
  qt AS (SELECT v, i, {_inv_norm_sql('m')} AS t FROM qm)"""


@register("qq_points", _QQ_SQL + """
SELECT CAST(i AS BIGINT) AS position, t AS theoretical, v AS ordered FROM qt""",
          ["theoretical", "ordered"])
def q_qq_points(spark, sf_dir):
    """Every point of the normal probability plot of the test residuals."""
    p = priced_table(spark, sf_dir).where("split = 'test'")
    return E.qq_points(p.withColumn("residual", F.col("actual") - F.col("predicted")))


@register("qq_fit_line", _QQ_SQL + """
SELECT regr_slope(v, t) AS slope, regr_intercept(v, t) AS intercept, corr(v, t) AS r FROM qt""",
          ["slope", "intercept", "r"])
def q_qq_fit_line(spark, sf_dir):
    """The line through the points."""
    p = priced_table(spark, sf_dir).where("split = 'test'")
    pts = E.qq_points(p.withColumn("residual", F.col("actual") - F.col("predicted")))
    return E.qq_fit(pts)


# --------------------------------------------------------------------------
# distributions behind the study's model plots
# --------------------------------------------------------------------------

from innsight.plans.profile_queries import _HIST, _hist_sql  # noqa: E402


@register("histogram_target", _hist_sql("avg_price_per_room", "split = 'train'", 50, "target_raw",
                                        src="psplits", prefix=PRICE_CTE), _HIST)
def q_histogram_target(spark, sf_dir):
    from innsight.operators.profile import histogram
    from innsight.plans.prepared import price_split_table
    t = price_split_table(spark, sf_dir).where("split = 'train'")
    return histogram(t, F.col("avg_price_per_room"), 50, "target_raw")


@register("histogram_log_target", _hist_sql("ln(1 + avg_price_per_room)", "split = 'train'", 50,
                                            "target_log1p", src="psplits", prefix=PRICE_CTE), _HIST)
def q_histogram_log_target(spark, sf_dir):
    from innsight.operators.profile import histogram
    from innsight.plans.prepared import price_split_table
    t = price_split_table(spark, sf_dir).where("split = 'train'")
    return histogram(t, F.log1p("avg_price_per_room"), 50, "target_log1p")


@register("histogram_prob_by_band", _hist_sql(
    "prob_cal", "split = 'test'", 30, "probability", "risk_band",
    src="(SELECT *, CASE WHEN prob_cal < 0.3 THEN 'low' WHEN prob_cal < 0.6 THEN 'medium' "
        "ELSE 'high' END AS risk_band FROM cal)", prefix=ISO_CTE), _HIST)
def q_histogram_prob_by_band(spark, sf_dir):
    from innsight.operators.profile import histogram
    cal = E.risk_bands(calibrated_flow(spark, sf_dir)[0], "prob_cal").where("split = 'test'")
    return histogram(cal, F.col("prob_cal"), 30, "probability", ["risk_band"])
