"""Evaluation, calibration and thresholds over a scored table.

Inputs are DataFrames with a 0/1 ``label``, a probability ``prob`` (or a
regression prediction) and usually a ``split``. Every metric is an
aggregate; rank-based ones (AUC, ROC) work on distinct scores with prefix
sums, so no row-level sort or single-task window is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions.columns import risk_band, scalar, scalars
from innsight.operators.ranks import bounded_broadcast, prefix_sums, segmented_prefix_sums, value_ranks
from innsight.schema import RISK_HIGH_LOWER, RISK_LOW_UPPER


def _div(a: Column, b: Column) -> Column:
    """a / b, or 0 when b is 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(scored: DataFrame, pred: Column, by: list[str], label: str = "label"):
    y = F.col(label)
    return scored.groupBy(*by).agg(
        F.sum(F.when((pred == 1) & (y == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((pred == 1) & (y == 0), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((pred == 0) & (y == 1), 1).otherwise(0)).alias("fn"),
        F.sum(F.when((pred == 0) & (y == 0), 1).otherwise(0)).alias("tn"),
        F.avg(F.pow(F.col("prob") - y, 2)).alias("brier") if "prob" in scored.columns
        else F.lit(None).cast("double").alias("brier"),
    )


def _metric_cols() -> list[Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = _div(tp, tp + fp)
    recall = _div(tp, tp + fn)
    return [
        _div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def roc_auc(scored: DataFrame, by: list[str] | tuple = ("split",), label: str = "label",
            score: str = "prob") -> DataFrame:
    """Exact ROC AUC per group (ties count one half), from average ranks of
    distinct scores: AUC = (R_pos - P(P+1)/2) / (P N). One class only -> NULL."""
    by = list(by)
    vr = value_ranks(scored, score, by, extra_counts={"_pos": F.col(label) == 1})
    s = vr.groupBy(*by).agg(F.sum(F.col("avg_rank") * F.col("_pos")).alias("_r"),
                            F.sum("_pos").cast("double").alias("_p"),
                            (F.sum("n") - F.sum("_pos")).cast("double").alias("_n"))
    auc = F.try_divide(F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2,
                       F.col("_p") * F.col("_n"))
    return s.select(*by, auc.alias("roc_auc"))


def classification_metrics(scored: DataFrame, threshold: float | Column = 0.5,
                           by: list[str] | tuple = ("split",), label: str = "label",
                           score: str = "prob") -> DataFrame:
    """accuracy, precision, recall, F1 (positive = 1, zero division -> 0), ROC
    AUC and Brier score per group, predicting 1 when score >= threshold."""
    by = list(by)
    s = scored if score == "prob" else scored.withColumn("prob", F.col(score))
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = (F.col("prob") >= t).cast("int")
    cm = confusion_counts(s, pred, by, label)
    auc = roc_auc(s, by, label, "prob")
    out = cm.select(*by, *_metric_cols(), "brier")
    # one row per group on each side (splits, models)
    if not by:
        return out.withColumn("roc_auc", scalar(auc, "roc_auc"))
    return out.join(bounded_broadcast(auc), by, "left")


def confusion_metrics(scored: DataFrame, threshold: float = 0.5, by: list[str] | tuple = ("split",),
                      label: str = "label") -> DataFrame:
    """accuracy, precision, recall and F1 per group, from confusion counts alone."""
    by = list(by)
    pred = (F.col("prob") >= F.lit(float(threshold))).cast("int")
    return confusion_counts(scored, pred, by, label).select(*by, *_metric_cols())


def confusion_matrix(scored: DataFrame, threshold: float = 0.5,
                     by: list[str] | tuple = ("split",), label: str = "label",
                     score: str = "prob") -> DataFrame:
    by = list(by)
    pred = (F.col(score) >= F.lit(float(threshold))).cast("int")
    return (scored.withColumn("predicted", pred)
            .groupBy(*by, F.col(label).alias("actual"), "predicted")
            .agg(F.count(F.lit(1)).alias("n")))


def roc_curve(scored: DataFrame, by: list[str] | tuple = ("split",), label: str = "label",
              score: str = "prob") -> DataFrame:
    """(fpr, tpr, threshold) at every distinct score, highest score first;
    collinear points are kept. Counts come from prefix sums over distinct
    scores (range-partitioned, no single-task window)."""
    by = list(by)
    g = (scored.where(F.col(score).isNotNull())
         .groupBy(*by, F.col(score).alias("threshold"))
         .agg(F.count(F.lit(1)).alias("n"),
              F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos")))
    if by:
        ps = segmented_prefix_sums(g, by, ["threshold"], ["n", "pos"])
        tot = g.groupBy(*by).agg(F.sum("n").alias("_N"), F.sum("pos").alias("_P"))
        ps = ps.join(bounded_broadcast(tot), by)  # one row per group (a few splits)
    else:
        ps = prefix_sums(g, ["threshold"], ["n", "pos"])
        tot = g.agg(F.sum("n").alias("_N"), F.sum("pos").alias("_P"))
        ps = ps.withColumns(scalars(tot))
    ps = ps.withColumn("_n0", F.lit(0)).withColumn("_p0", F.lit(0))
    # rows with score >= threshold = all rows minus rows strictly below
    pos_ge = F.col("_P") - (F.col("pos_before") - F.col("_p0"))
    all_ge = F.col("_N") - (F.col("n_before") - F.col("_n0"))
    neg_ge = all_ge - pos_ge
    return ps.select(*by, "threshold",
                     F.try_divide(neg_ge.cast("double"), F.col("_N") - F.col("_P")).alias("fpr"),
                     F.try_divide(pos_ge.cast("double"), F.col("_P")).alias("tpr"))


def roc_operating_point(curve: DataFrame, threshold: float,
                        by: list[str] | tuple = ("split",)) -> DataFrame:
    """The ROC point whose threshold is nearest to ``threshold`` (ties: the
    lower threshold)."""
    by = list(by)
    key = F.struct(F.abs(F.col("threshold") - F.lit(float(threshold))), F.col("threshold"))
    pt = F.min_by(F.struct("threshold", "fpr", "tpr"), key)
    r = curve.groupBy(*by).agg(pt.alias("_p"))
    return r.select(*by, "_p.threshold", "_p.fpr", "_p.tpr")


def brier_score(scored: DataFrame, by: list[str] | tuple = ("split",), label: str = "label",
                score: str = "prob") -> DataFrame:
    return scored.groupBy(*list(by)).agg(
        F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


# ---------------------------------------------------------------------------
# calibration
# ---------------------------------------------------------------------------

def fit_isotonic(val: DataFrame, label: str = "label", score: str = "prob"):
    """Monotone (isotonic) map from score to probability, fitted on validation
    rows; predictions interpolate linearly and clip outside the fitted range.

    Rows are collapsed to one per distinct score (mean label, weight = rows)
    before the fit, which gives the same map: a hot score is a single row."""
    from pyspark.ml.regression import IsotonicRegression
    points = val.groupBy(score).agg(F.avg(F.col(label).cast("double")).alias("_y"),
                                    F.count(F.lit(1)).cast("double").alias("_w"))
    return IsotonicRegression(featuresCol=score, labelCol="_y", weightCol="_w",
                              predictionCol="_iso", isotonic=True).fit(points)


def fit_sigmoid(val: DataFrame, label: str = "label", score: str = "prob"):
    """Platt scaling: one-feature logistic regression with C = 1 (L2 penalty
    1/(C n) in Spark's per-row-averaged objective)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    n = val.count()
    data = VectorAssembler(inputCols=[score], outputCol="_f").transform(val)
    return LogisticRegression(featuresCol="_f", labelCol=label, regParam=1.0 / max(n, 1),
                              elasticNetParam=0.0, standardization=False, maxIter=1000,
                              tol=1e-10).fit(data)


def apply_calibrator(df: DataFrame, calibrator, method: str, score: str = "prob",
                     out: str = "prob_cal") -> DataFrame:
    """Calibrated probability clipped to [0, 1]."""
    if method == "isotonic":
        t = calibrator.setFeaturesCol(score).setPredictionCol("_iso").transform(df)
        p = F.col("_iso")
        drop = ["_iso"]
    else:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        t = VectorAssembler(inputCols=[score], outputCol="_f").transform(df)
        t = calibrator.setFeaturesCol("_f").setProbabilityCol("_pp").setRawPredictionCol("_rp") \
            .setPredictionCol("_pr").transform(t)
        p = vector_to_array("_pp")[1]
        drop = ["_f", "_pp", "_rp", "_pr"]
    return t.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))).drop(*drop)


def isotonic_table(val: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """The fitted isotonic value at every distinct validation score."""
    model = fit_isotonic(val, label, score)
    pts = val.select(score).distinct()
    return apply_calibrator(pts, model, "isotonic", score, "calibrated")


def reliability_curve(scored: DataFrame, n_bins: int = 10, by: list[str] | tuple = ("split",),
                      label: str = "label", score: str = "prob") -> DataFrame:
    """Uniform-bin reliability table: mean predicted probability and fraction
    of positives per non-empty bin. A score exactly on an inner edge belongs
    to the lower bin (edges are i / n_bins as floating values)."""
    p = F.col(score)
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    b = sum((F.when(p > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return (scored.withColumn("bin", b.cast("bigint"))
            .groupBy(*list(by), "bin")
            .agg(F.avg(p).alias("mean_predicted"),
                 F.avg(F.col(label).cast("double")).alias("fraction_positive"),
                 F.count(F.lit(1)).alias("n")))


def sweep_thresholds(lo: int = 5, hi: int = 84) -> list[float]:
    """Thresholds lo/100 .. hi/100 built by division (no float accumulation)."""
    return [i / 100 for i in range(lo, hi + 1)]


def threshold_sweep(scored: DataFrame, thresholds: list[float] | None = None,
                    label: str = "label", score: str = "prob") -> DataFrame:
    """accuracy, precision, recall and F1 at each threshold.

    Each row is first mapped to the number of thresholds it reaches (a sum of
    comparisons inside codegen), counts are aggregated per (bucket, label) -
    at most (len(thresholds) + 1) x 2 rows - and only that small table is
    summed per threshold, so the work is one pass, whatever the data size."""
    ts = sorted(thresholds or sweep_thresholds())
    p = F.col(score)
    reach = sum((F.when(p >= F.lit(t), 1).otherwise(0) for t in ts), F.lit(0))
    buckets = (scored.withColumn("_b", reach)
               .groupBy("_b").agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
                                  F.count(F.lit(1)).alias("_n")))
    # threshold i predicts 1 for the buckets b >= i: conditional sums over the
    # bucket table in one aggregate, then one row per threshold
    aggs = [F.sum("_pos").alias("_P"), F.sum("_n").alias("_N")]
    for i in range(1, len(ts) + 1):
        at = F.col("_b") >= i
        aggs += [F.sum(F.when(at, F.col("_pos")).otherwise(0)).alias(f"_tp{i}"),
                 F.sum(F.when(at, F.col("_n") - F.col("_pos")).otherwise(0)).alias(f"_fp{i}")]
    wide = buckets.agg(*aggs).where(F.col("_N").isNotNull())   # no scored rows -> no rows
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i + 1}").alias("tp"),
                              F.col(f"_fp{i + 1}").alias("fp")) for i, t in enumerate(ts)])
    cm = wide.select("_P", "_N", F.explode(rows).alias("_r")).select(
        "_r.threshold", "_r.tp", "_r.fp", (F.col("_P") - F.col("_r.tp")).alias("fn"),
        (F.col("_N") - F.col("_P") - F.col("_r.fp")).alias("tn"))
    return cm.select("threshold", *_metric_cols())


def best_threshold(sweep: DataFrame, places: int = 4) -> DataFrame:
    """First threshold with the highest F1 rounded to ``places`` decimals."""
    key = F.struct(F.bround("f1", places).alias("f1r"), (-F.col("threshold")).alias("neg_t"))
    best = sweep.agg(F.max_by(F.struct(*sweep.columns), key).alias("_b"))
    return best.select("_b.*")


def risk_bands(df: DataFrame, prob: str = "prob", low_upper: float = RISK_LOW_UPPER,
               high_lower: float = RISK_HIGH_LOWER) -> DataFrame:
    return df.withColumn("risk_band", risk_band(prob, low_upper, high_lower))


def risk_band_distribution(scored: DataFrame, prob: str = "prob", label: str = "label",
                           splits: tuple = ("val", "test"), low_upper: float = RISK_LOW_UPPER,
                           high_lower: float = RISK_HIGH_LOWER) -> DataFrame:
    """Per split and band: n, share of split (pct), canceled, actual rate.
    All three bands appear even when empty (fixed 2 x 3 frame, broadcast)."""
    spark = scored.sparkSession
    frame = spark.createDataFrame([(s, b, i) for s in splits for i, b in
                                   enumerate(["low", "medium", "high"])],
                                  "split string, band string, band_order int")
    counts = (scored.where(F.col("split").isin(list(splits)))
              .withColumn("band", risk_band(prob, low_upper, high_lower))
              .groupBy("split", "band")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label)).alias("_c")))
    j = F.broadcast(frame).join(counts, ["split", "band"], "left").fillna(0, ["_n", "_c"])
    tot = F.sum("_n").over(Window.partitionBy("split"))  # over the 6-row frame only
    return j.select("split", "band", "band_order",
                    F.col("_n").cast("bigint").alias("n_bookings"),
                    (F.col("_n") * 100.0 / F.greatest(tot, F.lit(1))).alias("pct_of_split"),
                    F.col("_c").cast("bigint").alias("n_canceled"),
                    (F.col("_c") * 100.0 / F.greatest(F.col("_n"), F.lit(1))).alias("actual_cancel_rate"))


def overfitting_summary(metrics: DataFrame) -> DataFrame:
    """Long table (split, metric, value) plus the F1 gaps train-val and
    val-test, from a per-split metrics table."""
    cols = [c for c in ("accuracy", "precision", "recall", "f1", "roc_auc", "brier")
            if c in metrics.columns]
    items = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = metrics.selectExpr("split", f"stack({len(cols)}, {items}) AS (metric, value)")
    f1 = metrics.agg(
        F.max(F.when(F.col("split") == "train", F.col("f1"))).alias("tr"),
        F.max(F.when(F.col("split") == "val", F.col("f1"))).alias("va"),
        F.max(F.when(F.col("split") == "test", F.col("f1"))).alias("te"))
    gaps = f1.selectExpr("stack(2, 'train-val', 'f1_gap', tr - va, 'val-test', 'f1_gap', va - te) "
                         "AS (split, metric, value)")
    return long.unionByName(gaps)


# ---------------------------------------------------------------------------
# regression
# ---------------------------------------------------------------------------

def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       by: list[str] | tuple = ("split",)) -> DataFrame:
    """R^2 (1 - SSE / SST around the group's own mean), MAE and RMSE."""
    by = list(by)
    a, p = F.col(actual), F.col(predicted)
    s = df.groupBy(*by).agg(
        F.sum(F.pow(a - p, 2)).alias("_sse"), F.avg(F.abs(a - p)).alias("mae"),
        F.sqrt(F.avg(F.pow(a - p, 2))).alias("rmse"),
        (F.var_pop(a) * F.count(a)).alias("_sst"))
    return s.select(*by, (1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"), "mae", "rmse")


def residual_summary(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                     by: list[str] | tuple = ("split",)) -> DataFrame:
    r = F.col(actual) - F.col(predicted)
    return df.groupBy(*list(by)).agg(F.avg(r).alias("mean_residual"),
                                     F.stddev_pop(r).alias("std_residual"),
                                     F.count(F.lit(1)).alias("n"))


def predicted_vs_actual(df: DataFrame, actual: str = "actual", predicted: str = "predicted",
                        by: list[str] | tuple = ("split",)) -> DataFrame:
    """Joint min and max of actual and predicted: the frame of ``predicted_actual_pairs``."""
    a, p = F.col(actual), F.col(predicted)
    return df.groupBy(*list(by)).agg(F.least(F.min(a), F.min(p)).alias("frame_min"),
                                     F.greatest(F.max(a), F.max(p)).alias("frame_max"),
                                     F.corr(a, p).alias("corr"), F.count(F.lit(1)).alias("n"))


def predicted_actual_pairs(df: DataFrame, id_col: str = "Booking_ID") -> DataFrame:
    """Every row's actual and predicted value, with the frame of its split for the plot."""
    frame = predicted_vs_actual(df).select("split", "frame_min", "frame_max")
    return (df.join(F.broadcast(frame), "split")      # one row per split
            .select(id_col, "split", "actual", "predicted", "frame_min", "frame_max"))


def target_skew(df: DataFrame, target: str = "avg_price_per_room") -> DataFrame:
    """Bias-corrected skewness (pandas ``skew``) of the raw and log1p target."""
    def g1(x: Column) -> Column:
        n = F.count(x).cast("double")
        return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return df.agg(g1(F.col(target)).alias("skew_raw"),
                  g1(F.log1p(F.col(target))).alias("skew_log1p"))


def inverse_normal_cdf(p: Column) -> Column:
    """Standard normal quantile (rational approximation with relative error
    about 1e-9 in the tails), as a column expression for 0 < p < 1."""
    # fixed values: the published coefficients of the approximation
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]

    def horner(coefs, x):
        acc = F.lit(coefs[0])
        for k in coefs[1:]:
            acc = acc * x + F.lit(k)
        return acc

    plow = 0.02425
    q_low = F.sqrt(-2 * F.log(p))
    low = horner(c, q_low) / (horner(d, q_low) * q_low + 1)
    q_high = F.sqrt(-2 * F.log(1 - p))
    high = -horner(c, q_high) / (horner(d, q_high) * q_high + 1)
    q = p - 0.5
    r = q * q
    mid = horner(a, r) * q / (horner(b, r) * r + 1)
    return F.when(p < plow, low).when(p > 1 - plow, high).otherwise(mid)


def qq_points(df: DataFrame, value: str = "residual") -> DataFrame:
    """Normal probability plot points: each order statistic of ``value``
    against the normal quantile of its Filliben median position. Positions
    come from distributed prefix counts over distinct values."""
    vr = value_ranks(df, value)
    n = vr.agg(F.sum("n").alias("_N"))
    # Positions of a value's ties are generated in chunks of at most `chunk`
    # so that a very frequent value never becomes one giant array in a task.
    chunk = 1 << 20
    chunks = (vr.withColumns(scalars(n))
              .withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk))))
              .repartition(vr.sparkSession.sparkContext.defaultParallelism))
    start = F.col("n_before") + 1 + F.col("_c") * chunk
    stop = F.least(F.col("n_before") + F.col("n"), start + chunk - 1)
    pos = chunks.withColumn("i", F.explode(F.sequence(start, stop)))
    N = F.col("_N").cast("double")
    i = F.col("i").cast("double")
    last = F.pow(F.lit(0.5), 1.0 / N)
    m = (F.when(F.col("i") == F.col("_N"), last)
         .when(F.col("i") == 1, 1 - last)
         .otherwise((i - 0.3175) / (N + 0.365)))
    return pos.select(F.col("i").alias("position"), inverse_normal_cdf(m).alias("theoretical"),
                      F.col(value).cast("double").alias("ordered"))


def qq_fit(points: DataFrame) -> DataFrame:
    """Least-squares line of ordered values on theoretical quantiles."""
    return points.agg(F.regr_slope("ordered", "theoretical").alias("slope"),
                      F.regr_intercept("ordered", "theoretical").alias("intercept"),
                      F.corr("ordered", "theoretical").alias("r"))
