"""Feature engineering and encoding, as DataFrame functions and as Spark ML
pipeline stages (fitted on the training rows only, persisted with the model).

Every stage emits built-in column expressions; no Python UDF runs per row.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions.columns import arrival_dow, arrival_season
from innsight.schema import CANCEL_NUMERIC, CATEGORICAL, PRICE_NUMERIC, RARE_CATEGORY_MIN_COUNT

# fixed values: columns each feature set removes (only those present)
CANCEL_DROP = ["Booking_ID", "arrival_year", "arrival_date", "booking_status", "label",
               "is_zero_adults", "is_zero_nights"]
PRICE_DROP = ["Booking_ID", "arrival_year", "arrival_date", "booking_status", "label",
              "avg_price_per_room", "is_zero_adults", "is_zero_nights", "price_is_zero"]


def _derived(df: DataFrame, with_price: bool) -> dict:
    c = F.col
    prev_c = c("no_of_previous_cancellations")
    prev_k = c("no_of_previous_bookings_not_canceled")
    out = {
        "total_nights": c("no_of_weekend_nights") + c("no_of_week_nights"),
        "total_guests": c("no_of_adults") + c("no_of_children"),
        "has_children": (c("no_of_children") > 0).cast("int"),
        "log_lead_time": F.log1p(c("lead_time")),
    }
    if with_price:
        out["log_price"] = F.log1p(c("avg_price_per_room"))
        out["price_is_zero"] = (c("avg_price_per_room") == 0).cast("int")
    out.update({
        "is_weekend_stay": (c("no_of_weekend_nights") > 0).cast("int"),
        "has_special_request": (c("no_of_special_requests") > 0).cast("int"),
        "prior_cancel_rate": prev_c.cast("double") / (prev_c + prev_k + 1e-9),
        "arrival_season": arrival_season(),
        "arrival_dow": arrival_dow().cast("int"),
    })
    return out


def add_cancellation_features(df: DataFrame) -> DataFrame:
    return df.withColumns(_derived(df, True))


def add_price_features(df: DataFrame) -> DataFrame:
    return df.withColumns(_derived(df, False))


def features_cancellation(df: DataFrame) -> DataFrame:
    """The 11 derived cancellation features, identifier/target columns removed."""
    return add_cancellation_features(df).drop(*CANCEL_DROP)


def features_price(df: DataFrame) -> DataFrame:
    """The price-model variant: no price-derived features, price removed."""
    return add_price_features(df).drop(*PRICE_DROP)


def defined_extra_features(df: DataFrame) -> DataFrame:
    """has_parking and is_repeat_guest, catalogued features of the study."""
    return df.withColumns({
        "has_parking": (F.col("required_car_parking_space") == 1).cast("int"),
        "is_repeat_guest": F.col("repeated_guest").cast("int"),
    })


def log_target(df: DataFrame, target: str = "avg_price_per_room") -> DataFrame:
    return df.withColumn(f"log_{target}", F.log1p(F.col(target)))


def target_encoding(train: DataFrame, cols: list[str] = CATEGORICAL,
                    label: str = "label") -> DataFrame:
    """Mean label per category on the training rows (no smoothing):
    (column_name, category, encoding, n)."""
    items = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = train.selectExpr(f"stack({len(cols)}, {items}) AS (column_name, category)",
                            f"CAST(`{label}` AS DOUBLE) AS _y")
    return long.groupBy("column_name", "category").agg(
        F.avg("_y").alias("encoding"), F.count(F.lit(1)).alias("n"))


def apply_target_encoding(df: DataFrame, enc: DataFrame, cols: list[str] = CATEGORICAL,
                          suffix: str = "_encoded") -> DataFrame:
    """Join each category's encoding; broadcast while the counted categories are within a bound. The encodings are
    written once: each column counts and joins them, which else would scan the training rows anew."""
    from innsight.operators.ranks import bounded_broadcast
    from innsight.session import written
    enc, out = written(enc, "target-encoding"), df
    for c in cols:
        e = enc.where(F.col("column_name") == c).select(
            F.col("category").alias(c), F.col("encoding").alias(c + suffix))
        out = out.join(bounded_broadcast(e), c, "left")
    return out


# ---------------------------------------------------------------------------
# ML stages
# ---------------------------------------------------------------------------

class BookingFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the derived features (``kind`` = 'cancellation' or 'price');
    keeps every input column so labels and ids pass through."""

    kind = Param(Params._dummy(), "kind", "cancellation or price",
                 typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, kind: str = "cancellation"):
        super().__init__()
        self._setDefault(kind="cancellation")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getOrDefault(self.kind) == "price":
            return add_price_features(dataset)
        return add_cancellation_features(dataset)


class _ColsParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "input columns",
                      typeConverter=TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "output columns",
                       typeConverter=TypeConverters.toListString)


class PopulationScaler(Estimator, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    """z-score with the population standard deviation (a constant column maps
    to 0). Mean and deviation come from one aggregate over the fit rows."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        cols = self.getOrDefault(self.inputCols)
        aggs = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = dataset.agg(*aggs).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
        m = PopulationScalerModel(inputCols=cols, outputCols=self.getOrDefault(self.outputCols),
                                  means=means, stds=stds)
        return m


class PopulationScalerModel(Model, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "fitted means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population std",
                 typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.inputCols)
        outs = self.getOrDefault(self.outputCols)
        means = self.getOrDefault(self.means)
        stds = self.getOrDefault(self.stds)
        return dataset.withColumns({
            o: (F.col(c).cast("double") - m) / (s if s > 0 else 1.0)
            for c, o, m, s in zip(cols, outs, means, stds)})


def onehot_name(col: str, value: str) -> str:
    return f"cat__{col}_{value}"


INFREQUENT = "infrequent_sklearn"


class RareCategoryOneHot(Estimator, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot encoding where categories seen fewer than ``minCount`` times in
    the fit rows share one 'infrequent' column. An unseen value goes to that
    column if it exists, otherwise it is all zeros."""

    minCount = Param(Params._dummy(), "minCount", "rare category limit",
                     typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, minCount: int = RARE_CATEGORY_MIN_COUNT):
        super().__init__()
        self._setDefault(minCount=RARE_CATEGORY_MIN_COUNT)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "RareCategoryOneHotModel":
        cols = self.getOrDefault(self.inputCols)
        lim = self.getOrDefault(self.minCount)
        items = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
        counts = (dataset.selectExpr(f"stack({len(cols)}, {items}) AS (column_name, value)")
                  .where(F.col("value").isNotNull())
                  .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
        # rare categories, of which there may be any number, stay on the cluster:
        # the driver gets the frequent names and one flag per column
        seen: dict[str, list[str]] = {c: [] for c in cols}
        for r in counts.where(F.col("n") >= lim).select("column_name", "value").collect():
            seen[r["column_name"]].append(r["value"])
        some_rare = {r["column_name"] for r in counts.where(F.col("n") < lim)
                     .select("column_name").distinct().collect()}
        frequent = [sorted(seen[c]) for c in cols]
        rare = [c in some_rare for c in cols]
        return RareCategoryOneHotModel(inputCols=cols, categories=frequent,
                                       hasInfrequent=[bool(x) for x in rare])


class RareCategoryOneHotModel(Model, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    categories = Param(Params._dummy(), "categories", "frequent categories per column")
    hasInfrequent = Param(Params._dummy(), "hasInfrequent", "whether a rare column exists")

    @keyword_only
    def __init__(self, inputCols=None, categories=None, hasInfrequent=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def feature_names(self) -> list[str]:
        names = []
        for c, cats, rare in zip(self.getOrDefault(self.inputCols),
                                 self.getOrDefault(self.categories),
                                 self.getOrDefault(self.hasInfrequent)):
            names += [onehot_name(c, v) for v in cats]
            if rare:
                names.append(onehot_name(c, INFREQUENT))
        return names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        new = {}
        for c, cats, rare in zip(self.getOrDefault(self.inputCols),
                                 self.getOrDefault(self.categories),
                                 self.getOrDefault(self.hasInfrequent)):
            x = F.col(c).cast("string")
            for v in cats:
                new[onehot_name(c, v)] = F.coalesce((x == F.lit(v)).cast("double"), F.lit(0.0))
            if rare:
                new[onehot_name(c, INFREQUENT)] = F.coalesce(
                    (~x.isin(cats)).cast("double"), F.lit(1.0))
        return dataset.withColumns(new)


def preprocessing_stages(kind: str = "cancellation") -> list:
    """Feature derivation, population scaling of the numeric block and the
    rare-category one-hot block (all fitted on whatever rows ``fit`` sees).
    The assembler is added by ``assembler_for`` once names are known."""
    numeric = CANCEL_NUMERIC if kind == "cancellation" else PRICE_NUMERIC
    return [
        BookingFeatures(kind=kind),
        PopulationScaler(inputCols=numeric, outputCols=[f"num__{c}" for c in numeric]),
        RareCategoryOneHot(inputCols=CATEGORICAL),
    ]


def fit_preprocessor(train: DataFrame, kind: str = "cancellation"):
    """Fit the preprocessing stages on training rows; returns
    (PipelineModel with assembler, feature names)."""
    from pyspark.ml import Pipeline, PipelineModel
    stages = preprocessing_stages(kind)
    fitted = Pipeline(stages=stages).fit(train)
    numeric = CANCEL_NUMERIC if kind == "cancellation" else PRICE_NUMERIC
    names = [f"num__{c}" for c in numeric] + fitted.stages[-1].feature_names()
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return PipelineModel(stages=list(fitted.stages) + [assembler]), names


def clean_feature_name(name_col):
    """'num__lead_time' -> 'lead_time'; '..._infrequent_sklearn' -> '... (rare)'."""
    x = F.regexp_replace(name_col, r"^(num__|cat__)", "")
    return F.replace(x, F.lit("_" + INFREQUENT), F.lit(" (rare)"))
