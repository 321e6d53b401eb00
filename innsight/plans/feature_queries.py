"""Registered queries for features, encodings and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from innsight.operators import evaluate as E
from innsight.operators import features as FE
from innsight.operators.split import class_weights, hash_split, split_sizes
from innsight.plans.prepared import price_split_table, split_table
from innsight.plans.registry import register
from innsight.plans.sqltext import CLEAN_CTE, PRICE_CTE, features_select, split_cte
from innsight.schema import BOOKING_COLUMNS, CANCEL_NUMERIC, CATEGORICAL
from innsight.sources.bookings import bookings_table

_KEEP_CANCEL = [n for n, _ in BOOKING_COLUMNS if n not in FE.CANCEL_DROP]
_KEEP_PRICE = [n for n, _ in BOOKING_COLUMNS if n not in FE.PRICE_DROP]
_FEAT_DOUBLES = ["log_lead_time", "log_price", "prior_cancel_rate", "avg_price_per_room"]


@register("features_cancellation",
          f"SELECT {', '.join(_KEEP_CANCEL)}, {features_select('cancellation')} FROM bookings",
          _FEAT_DOUBLES)
def q_features_cancellation(spark, sf_dir):
    return FE.features_cancellation(bookings_table(spark, sf_dir))


@register("features_price",
          f"SELECT {', '.join(_KEEP_PRICE)}, {features_select('price')} FROM bookings",
          ["log_lead_time", "prior_cancel_rate"])
def q_features_price(spark, sf_dir):
    return FE.features_price(bookings_table(spark, sf_dir))


@register("defined_extra_features", """
SELECT Booking_ID, CAST(required_car_parking_space = 1 AS INTEGER) AS has_parking,
       CAST(repeated_guest AS INTEGER) AS is_repeat_guest FROM bookings""")
def q_defined_extra_features(spark, sf_dir):
    return FE.defined_extra_features(bookings_table(spark, sf_dir)).select(
        "Booking_ID", "has_parking", "is_repeat_guest")


@register("log_target", """
SELECT Booking_ID, avg_price_per_room, ln(1 + avg_price_per_room) AS log_avg_price_per_room,
       exp(ln(1 + avg_price_per_room)) - 1 AS restored
FROM bookings WHERE avg_price_per_room > 0""",
          ["avg_price_per_room", "log_avg_price_per_room", "restored"])
def q_log_target(spark, sf_dir):
    df = FE.log_target(bookings_table(spark, sf_dir).where(F.col("avg_price_per_room") > 0))
    return df.select("Booking_ID", "avg_price_per_room", "log_avg_price_per_room",
                     F.expm1("log_avg_price_per_room").alias("restored"))


_SPLITS = CLEAN_CTE + split_cte("clean", "splits")


@register("stratified_split", _SPLITS + "\nSELECT Booking_ID, label, split FROM splits")
def q_stratified_split(spark, sf_dir):
    return split_table(spark, sf_dir).select("Booking_ID", "label", "split")


@register("stratified_split_hash", CLEAN_CTE + """
, hashed AS (SELECT Booking_ID, label, CAST('0x' || substr(md5('42:' || CAST(Booking_ID AS VARCHAR)), 1, 8) AS BIGINT) AS place
        FROM clean)
SELECT Booking_ID, label, CASE WHEN place < floor(0.2::DOUBLE * 4294967296) THEN 'test'
  WHEN place < floor(0.4::DOUBLE * 4294967296) THEN 'val' ELSE 'train' END AS split FROM hashed""")
def q_stratified_split_hash(spark, sf_dir):
    """The split decided by each row's own hash: nothing is counted, and old rows never move."""
    rows = split_table(spark, sf_dir).select("Booking_ID", "label")
    return hash_split(rows).select("Booking_ID", "label", "split")


@register("split_sizes", _SPLITS + """
SELECT split, COUNT(*) AS n_rows, CAST(SUM(label) AS BIGINT) AS n_canceled,
       AVG(CAST(label AS DOUBLE)) * 100.0 AS pct_canceled
FROM splits GROUP BY split""", ["pct_canceled"])
def q_split_sizes(spark, sf_dir):
    return split_sizes(split_table(spark, sf_dir))


@register("random_split", PRICE_CTE + """
SELECT split, COUNT(*) AS n_rows, AVG(avg_price_per_room) AS mean,
       quantile_cont(avg_price_per_room, 0.5) AS median, STDDEV_SAMP(avg_price_per_room) AS std,
       MIN(avg_price_per_room) AS min, MAX(avg_price_per_room) AS max
FROM psplits GROUP BY split""", ["mean", "median", "std", "min", "max"])
def q_random_split(spark, sf_dir):
    from innsight.operators.ranks import exact_quantiles
    p = price_split_table(spark, sf_dir)
    med = (exact_quantiles(p, "avg_price_per_room", [0.5], ["split"])
           .select("split", F.col("value").alias("median")))
    stats = p.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("avg_price_per_room").alias("mean"),
        F.stddev_samp("avg_price_per_room").alias("std"),
        F.min("avg_price_per_room").alias("min"), F.max("avg_price_per_room").alias("max"))
    return stats.join(med, "split")


@register("class_weights", _SPLITS + """
, tr AS (SELECT * FROM splits WHERE split = 'train')
SELECT label, COUNT(*) AS n,
       (SELECT COUNT(*) FROM tr) / (2.0 * COUNT(*)) AS weight,
       CAST(FLOOR((SELECT CAST(SUM(1 - label) AS DOUBLE) FROM tr) / (SELECT SUM(label) FROM tr)) AS BIGINT)
         AS scale_pos_weight
FROM tr GROUP BY label""", ["weight"])
def q_class_weights(spark, sf_dir):
    return class_weights(split_table(spark, sf_dir))


# ---------------------------------------------------------------------------
# fitted encodings (training rows only)
# ---------------------------------------------------------------------------

def _train_features_sql() -> str:
    return _SPLITS + f"""
, tf AS (SELECT *, {features_select('cancellation')} FROM splits WHERE split = 'train')"""


@register("standard_scale", _train_features_sql() + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, AVG(CAST({c} AS DOUBLE)) AS mean, "
    f"STDDEV_POP(CAST({c} AS DOUBLE)) AS std FROM tf" for c in CANCEL_NUMERIC), ["mean", "std"])
def q_standard_scale(spark, sf_dir):
    train = FE.add_cancellation_features(split_table(spark, sf_dir).where("split = 'train'"))
    model = FE.PopulationScaler(inputCols=CANCEL_NUMERIC,
                                outputCols=[f"num__{c}" for c in CANCEL_NUMERIC]).fit(train)
    rows = list(zip(CANCEL_NUMERIC, model.getOrDefault(model.means), model.getOrDefault(model.stds)))
    return spark.createDataFrame(rows, "column_name string, mean double, std double")


_SCALED_CTE = _SPLITS + f"""
, af AS (SELECT *, {features_select('cancellation')} FROM splits),
  sm AS (SELECT {", ".join(f"AVG(CAST({c} AS DOUBLE)) AS m_{c}, STDDEV_POP(CAST({c} AS DOUBLE)) AS s_{c}"
                           for c in CANCEL_NUMERIC)} FROM af WHERE split = 'train'),
  sc AS (SELECT Booking_ID, {", ".join(
      f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS num__{c}"
      for c in CANCEL_NUMERIC)} FROM af, sm)"""


@register("scaled_rows", _SCALED_CTE + "\nSELECT * FROM sc", [f"num__{c}" for c in CANCEL_NUMERIC])
def q_scaled_rows(spark, sf_dir):
    """Every row's scaled numeric features, fitted on the training rows."""
    rows = FE.add_cancellation_features(split_table(spark, sf_dir))
    outs = [f"num__{c}" for c in CANCEL_NUMERIC]
    model = FE.PopulationScaler(inputCols=CANCEL_NUMERIC, outputCols=outs).fit(rows.where("split = 'train'"))
    return model.transform(rows).select("Booking_ID", *outs)


_CAT_COUNTS = _SPLITS + ", cc AS (" + " UNION ALL ".join(
    f"SELECT {i} AS col_idx, '{c}' AS column_name, CAST({c} AS VARCHAR) AS category, COUNT(*) AS n_train "
    f"FROM splits WHERE split = 'train' GROUP BY {c}" for i, c in enumerate(CATEGORICAL)) + ")"


@register("one_hot_infrequent", _CAT_COUNTS + """
SELECT column_name, category, n_train,
       'cat__' || column_name || '_' || CASE WHEN n_train >= 10 THEN category ELSE 'infrequent_sklearn' END
         AS output_feature
FROM cc""")
def q_one_hot_infrequent(spark, sf_dir):
    train = split_table(spark, sf_dir).where("split = 'train'")
    model = FE.RareCategoryOneHot(inputCols=CATEGORICAL).fit(train)
    items = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in CATEGORICAL)
    counts = (train.selectExpr(f"stack({len(CATEGORICAL)}, {items}) AS (column_name, category)")
              .groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("n_train")))
    # the fitted vocabulary (a few names) decides each category's output column
    vocab = [(c, v) for c, cats in zip(CATEGORICAL, model.getOrDefault(model.categories)) for v in cats]
    known = spark.createDataFrame(vocab, "column_name string, category string").withColumn("_k", F.lit(1))
    out = counts.join(F.broadcast(known), ["column_name", "category"], "left")
    name = F.concat(F.lit("cat__"), F.col("column_name"), F.lit("_"),
                    F.when(F.col("_k") == 1, F.col("category")).otherwise(F.lit(FE.INFREQUENT)))
    return out.select("column_name", "category", "n_train", name.alias("output_feature"))


_HOT_SQL = ", ".join(
    f"(SELECT 'cat__{c}_' || CASE WHEN cc.n_train >= 10 THEN cc.category ELSE 'infrequent_sklearn' END FROM cc "
    f"WHERE cc.column_name = '{c}' AND cc.category = CAST(s.{c} AS VARCHAR)) AS hot_{i}"
    for i, c in enumerate(CATEGORICAL))


@register("encoded_rows", _CAT_COUNTS + f"""
, hr AS (SELECT Booking_ID, {_HOT_SQL} FROM splits s WHERE split = 'train')
SELECT Booking_ID, concat_ws(', ', {", ".join(f"hot_{i}" for i in range(len(CATEGORICAL)))}) AS hot_columns FROM hr""")
def q_encoded_rows(spark, sf_dir):
    """The one-hot columns that are 1 in each training row, in column order."""
    train = split_table(spark, sf_dir).where("split = 'train'")
    model = FE.RareCategoryOneHot(inputCols=CATEGORICAL).fit(train)
    hot = [F.when(F.col(f"`{n}`") == 1.0, F.lit(n)) for n in model.feature_names()]
    return model.transform(train).select("Booking_ID", F.concat_ws(", ", *hot).alias("hot_columns"))


@register("target_encoded_rows", _SPLITS + ", " + ", ".join(
    f"te{i} AS (SELECT {c}, AVG(CAST(label AS DOUBLE)) AS e FROM splits WHERE split = 'train' GROUP BY {c})"
    for i, c in enumerate(CATEGORICAL)) + "\nSELECT Booking_ID, " + ", ".join(
    f"te{i}.e AS {c}_encoded" for i, c in enumerate(CATEGORICAL)) + " FROM splits s " + " ".join(
    f"LEFT JOIN te{i} ON s.{c} = te{i}.{c}" for i, c in enumerate(CATEGORICAL)),
          [f"{c}_encoded" for c in CATEGORICAL])
def q_target_encoded_rows(spark, sf_dir):
    """Every row's categories replaced by the training rows' cancellation rates."""
    rows = split_table(spark, sf_dir)
    enc = FE.target_encoding(rows.where("split = 'train'"))
    rows = rows.withColumns({c: F.col(c).cast("string") for c in CATEGORICAL})
    return FE.apply_target_encoding(rows, enc).select("Booking_ID", *[f"{c}_encoded" for c in CATEGORICAL])


@register("assembled_rows", _SCALED_CTE + f"""
, v AS (SELECT Booking_ID, {" + ".join(f"{i + 1} * num__{c}" for i, c in enumerate(CANCEL_NUMERIC))} AS weighted
        FROM sc)
SELECT v.Booking_ID, weighted, CAST({len(CATEGORICAL)} AS DOUBLE) AS n_hot
FROM v JOIN splits s ON v.Booking_ID = s.Booking_ID WHERE split = 'train'""", ["weighted", "n_hot"])
def q_assembled_rows(spark, sf_dir):
    """The assembled vector of every training row: its numeric block weighted
    by place, and the sum of its one-hot block."""
    from pyspark.ml.functions import vector_to_array
    train = split_table(spark, sf_dir).where("split = 'train'")
    model, names = FE.fit_preprocessor(train, "cancellation")
    n = len(CANCEL_NUMERIC)
    x = vector_to_array("features")
    place = sum((x[i] * (i + 1) for i in range(n)), F.lit(0.0))
    hot = sum((x[i] for i in range(n, len(names))), F.lit(0.0))
    return model.transform(train).select("Booking_ID", place.alias("weighted"), hot.alias("n_hot"))


@register("assemble_features", _CAT_COUNTS + f"""
, num AS (SELECT * FROM (VALUES {', '.join(f"({i}, 'num__{c}')" for i, c in enumerate(CANCEL_NUMERIC))})
          AS t(feature_index, feature_name)),
  cat AS (SELECT DISTINCT col_idx, column_name, CASE WHEN n_train >= 10 THEN 0 ELSE 1 END AS is_rare,
                 CASE WHEN n_train >= 10 THEN category ELSE 'infrequent_sklearn' END AS v FROM cc)
SELECT CAST(feature_index AS BIGINT) AS feature_index, feature_name FROM num
UNION ALL
SELECT CAST({len(CANCEL_NUMERIC)} - 1 + ROW_NUMBER() OVER (ORDER BY col_idx, is_rare, v) AS BIGINT),
       'cat__' || column_name || '_' || v FROM cat""")
def q_assemble_features(spark, sf_dir):
    train = split_table(spark, sf_dir).where("split = 'train'")
    _, names = FE.fit_preprocessor(train, "cancellation")
    return spark.createDataFrame(list(enumerate(names)), "feature_index bigint, feature_name string")


@register("clean_feature_names", _CAT_COUNTS + f"""
, num AS (SELECT * FROM (VALUES {', '.join(f"('num__{c}')" for c in CANCEL_NUMERIC)}) AS t(feature_name)),
  cat AS (SELECT DISTINCT 'cat__' || column_name || '_' ||
                 CASE WHEN n_train >= 10 THEN category ELSE 'infrequent_sklearn' END AS feature_name FROM cc),
  alln AS (SELECT feature_name FROM num UNION ALL SELECT feature_name FROM cat)
SELECT feature_name, replace(regexp_replace(feature_name, '^(num__|cat__)', ''), '_infrequent_sklearn', ' (rare)')
       AS clean_name FROM alln""")
def q_clean_feature_names(spark, sf_dir):
    train = split_table(spark, sf_dir).where("split = 'train'")
    _, names = FE.fit_preprocessor(train, "cancellation")
    df = spark.createDataFrame([(n,) for n in names], "feature_name string")
    return df.withColumn("clean_name", FE.clean_feature_name(F.col("feature_name")))


@register("target_encode", _SPLITS + ", te AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS category, CAST(label AS DOUBLE) AS y "
    f"FROM splits WHERE split = 'train'" for c in CATEGORICAL) + """)
SELECT column_name, category, AVG(y) AS encoding, COUNT(*) AS n FROM te GROUP BY column_name, category""",
          ["encoding"])
def q_target_encode(spark, sf_dir):
    return FE.target_encoding(split_table(spark, sf_dir).where("split = 'train'"))


# ---------------------------------------------------------------------------
# baselines without a fitted model
# ---------------------------------------------------------------------------

@register("fit_dummy_classifier", _SPLITS + """
, mf AS (SELECT label AS majority FROM splits WHERE split = 'train' GROUP BY label
         ORDER BY COUNT(*) DESC, label LIMIT 1),
  cm AS (SELECT split,
           SUM(CASE WHEN majority = 1 AND label = 1 THEN 1 ELSE 0 END) AS tp,
           SUM(CASE WHEN majority = 1 AND label = 0 THEN 1 ELSE 0 END) AS fp,
           SUM(CASE WHEN majority = 0 AND label = 1 THEN 1 ELSE 0 END) AS fn,
           SUM(CASE WHEN majority = 0 AND label = 0 THEN 1 ELSE 0 END) AS tn,
           AVG(POWER(CAST(majority AS DOUBLE) - label, 2)) AS brier
         FROM splits, mf GROUP BY split)
SELECT split, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision,
       COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS recall,
       COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1, brier, 0.5 AS roc_auc
FROM cm""", ["accuracy", "precision", "recall", "f1", "brier", "roc_auc"])
def q_fit_dummy_classifier(spark, sf_dir):
    from innsight.operators.models import fit_dummy_classifier
    s = split_table(spark, sf_dir)
    return E.classification_metrics(fit_dummy_classifier(s).transform(s), 0.5)


@register("fit_dummy_regressor", PRICE_CTE + """
, mu AS (SELECT AVG(avg_price_per_room) AS m FROM psplits WHERE split = 'train')
SELECT split, 1 - SUM(POWER(avg_price_per_room - m, 2)) / (VAR_POP(avg_price_per_room) * COUNT(*)) AS r2,
       AVG(ABS(avg_price_per_room - m)) AS mae, SQRT(AVG(POWER(avg_price_per_room - m, 2))) AS rmse
FROM psplits, mu GROUP BY split""", ["r2", "mae", "rmse"])
def q_fit_dummy_regressor(spark, sf_dir):
    from innsight.operators.models import fit_dummy_regressor
    p = price_split_table(spark, sf_dir)
    pred = fit_dummy_regressor(p).transform(p)
    return E.regression_metrics(pred.withColumnRenamed("avg_price_per_room", "actual")
                                .withColumnRenamed("prediction", "predicted"))


@register("target_skew", PRICE_CTE + """
SELECT skewness(avg_price_per_room) AS skew_raw, skewness(ln(1 + avg_price_per_room)) AS skew_log1p
FROM psplits WHERE split = 'train'""", ["skew_raw", "skew_log1p"])
def q_target_skew(spark, sf_dir):
    return E.target_skew(price_split_table(spark, sf_dir).where("split = 'train'"))

