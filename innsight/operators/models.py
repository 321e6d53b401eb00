"""Model fitting on Spark ML: baselines, linear models, trees and boosting.

Every estimator is a ``Pipeline`` of the feature stages (fitted on the
training rows only) and a Spark ML estimator; training runs distributed
(tree levels and gradients are aggregated on executors). Driver loops only
iterate over model configurations, never over rows.

Equivalences with the study's settings:
- L2 logistic with C and balanced class weights -> regParam = 1 / (C * sum(w)),
  standardization off (same minimiser for Spark's averaged objective).
- Ridge with alpha -> regParam = alpha * std(y) / n, standardization off.
- Boosted trees: ``boosting.BoostedTrees``, second-order with the study's L1, L2,
  least gain, least hessian of a child and columns per tree; the positive-class
  weight becomes a row weight.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       LogisticRegression)
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.functions.columns import scalar
from innsight.operators.boosting import BoostedTrees, Fold
from innsight.operators.features import preprocessing_stages
from innsight.operators.split import with_class_weight
from innsight.schema import SEED
from innsight.session import side_by_side

# fixed values: the tuned boosted-tree settings of the study
BOOSTED_CLASSIFIER = dict(maxIter=500, maxDepth=7, stepSize=0.08, subsamplingRate=0.9, columnRate=0.8,
                          minSplitGain=0.3, l1=0.1, l2=3.0, minChildWeight=1.0)
BOOSTED_REGRESSOR = dict(maxIter=300, maxDepth=7, stepSize=0.15, subsamplingRate=0.6, columnRate=0.6,
                         minSplitGain=0.1, l1=0.1, l2=1.0, minChildWeight=3.0)


class PrefixAssembler(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Assemble every column whose name starts with one of ``prefixes`` (in
    column order) into ``features``; the one-hot block's width is only known
    after fitting, so the names are resolved at transform time."""

    prefixes = Param(Params._dummy(), "prefixes", "column prefixes",
                     typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, prefixes=None):
        super().__init__()
        self._setDefault(prefixes=["num__", "cat__"])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pre = tuple(self.getOrDefault(self.prefixes))
        cols = [c for c in dataset.columns if c.startswith(pre)]
        return VectorAssembler(inputCols=cols, outputCol="features",
                               handleInvalid="keep").transform(dataset)


def feature_names(model) -> list[str]:
    """Names of the assembled features of a fitted pipeline."""
    stages = model.stages
    scaler = next(s for s in stages if hasattr(s, "means"))
    onehot = next(s for s in stages if hasattr(s, "feature_names"))
    names = list(scaler.getOrDefault(scaler.outputCols)) + onehot.feature_names()
    sel = next((s for s in stages if isinstance(s, ImportanceSelectorModel)), None)
    if sel is not None:
        names = [names[i] for i in sel.getOrDefault(sel.indices)]
    return names


class ImportanceSelector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Keep the features whose importance in a quick boosted model (50 trees,
    depth 4) is at least the mean importance."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", typeConverter=TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "tree depth", typeConverter=TypeConverters.toInt)
    labelCol = Param(Params._dummy(), "labelCol", "label", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, numTrees: int = 50, depth: int = 4, labelCol: str = "label"):
        super().__init__()
        self._setDefault(numTrees=50, depth=4, labelCol="label")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ImportanceSelectorModel":
        gbt = GBTClassifier(featuresCol="features", labelCol=self.getOrDefault(self.labelCol),
                            maxIter=self.getOrDefault(self.numTrees),
                            maxDepth=self.getOrDefault(self.depth), seed=SEED)
        imp = gbt.fit(dataset).featureImportances.toArray()
        mean = float(imp.mean()) if len(imp) else 0.0
        keep = [int(i) for i, v in enumerate(imp) if v >= mean] or list(range(len(imp)))
        return ImportanceSelectorModel(indices=keep, importances=[float(v) for v in imp])


class ImportanceSelectorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    indices = Param(Params._dummy(), "indices", "kept feature indices",
                    typeConverter=TypeConverters.toListInt)
    importances = Param(Params._dummy(), "importances", "quick model importances",
                        typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, indices=None, importances=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sliced = VectorSlicer(inputCol="features", outputCol="_sel",
                              indices=self.getOrDefault(self.indices)).transform(dataset)
        return sliced.drop("features").withColumnRenamed("_sel", "features")


# ---------------------------------------------------------------------------
# baselines
# ---------------------------------------------------------------------------

class ConstantModel(Transformer):
    """Adds a constant ``prob`` (classifier) or ``prediction`` (regressor)."""

    def __init__(self, column: str, value: float):
        super().__init__()
        self.column, self.value = column, float(value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.column, F.lit(self.value))


def fit_dummy_classifier(split_df: DataFrame, label: str = "label") -> ConstantModel:
    """Most frequent training class; its probability of class 1 is 0 or 1."""
    row = (split_df.where("split = 'train'").groupBy(label).count()
           .orderBy(F.desc("count"), F.asc(label)).first())
    return ConstantModel("prob", float(row[label]))


def fit_dummy_regressor(split_df: DataFrame, target: str = "avg_price_per_room") -> ConstantModel:
    """Arithmetic mean of the raw training target."""
    m = split_df.where("split = 'train'").agg(F.avg(target)).first()[0]
    return ConstantModel("prediction", m)


# ---------------------------------------------------------------------------
# classifiers
# ---------------------------------------------------------------------------

def _with_prob(df: DataFrame) -> DataFrame:
    return df.withColumn("prob", vector_to_array("probability")[1])


def fit_staged(pipeline: Pipeline, train: DataFrame, n_prep: int):
    """Fit a pipeline whose first ``n_prep`` stages are feature preparation:
    those are fitted once, the assembled vectors are cached, and the model
    stages (which pass over the data many times) read the cached vectors.
    Returns one ``PipelineModel`` with all stages."""
    from pyspark.ml import PipelineModel
    stages = pipeline.getStages()
    prep = Pipeline(stages=stages[:n_prep]).fit(train)
    # cache only what the model stages read (vector, label, weight), not the
    # booking columns and intermediate features
    cols = {"features"}
    for st in stages[n_prep:]:
        for p in ("featuresCol", "labelCol", "weightCol"):
            if st.hasParam(p) and st.isDefined(p) and st.getOrDefault(p):
                cols.add(st.getOrDefault(p))
    cached = prep.transform(spread(train)).select(*sorted(cols)).cache()
    try:
        rest = Pipeline(stages=stages[n_prep:]).fit(packed(cached))
    finally:
        cached.unpersist()
    return PipelineModel(stages=list(prep.stages) + list(rest.stages))


ROWS_PER_PARTITION, ROWS_PER_TASK = 16_384, 262_144


def spread(df: DataFrame) -> DataFrame:
    """Rows over enough partitions that a fit's task reads and caches at most some ROWS_PER_TASK vectors: a
    Parquet split of compressed bookings holds millions of rows, whose vectors are twenty times as large."""
    want = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(want) if want > 1 and want > df.rdd.getNumPartitions() else df


def over_cores(df: DataFrame) -> DataFrame:
    """Rows for a costly step on each of them (hundreds of trees): over all cores, where the table's own partitions are
    fewer and its rows fill more."""
    want = min(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_PER_PARTITION)
    return df.repartition(want) if want > df.rdd.getNumPartitions() else df


def packed(cached: DataFrame) -> DataFrame:
    """Cached vectors for a model that passes over them thousands of times: no more
    partitions than rows / ROWS_PER_PARTITION, so that small training sets
    don't pay for empty tasks. Large sets keep their partitions. The count fills
    the cache, so the preparation runs once."""
    want = max(1, -(-cached.count() // ROWS_PER_PARTITION))
    return cached.coalesce(want) if want < cached.rdd.getNumPartitions() else cached


N_PREP = 4  # feature derivation, scaler, one-hot, assembler


def classifier_pipeline(estimator, select_features: bool = False) -> Pipeline:
    stages = preprocessing_stages("cancellation") + [PrefixAssembler()]
    if select_features:
        stages.append(ImportanceSelector())
    return Pipeline(stages=stages + [estimator])


def logistic(C: float = 1.0, n_weight: float = 1.0) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                              regParam=1.0 / (C * n_weight), elasticNetParam=0.0,
                              standardization=False, maxIter=1000, tol=1e-6)


def fit_logistic(split_df: DataFrame, C: float = 1.0, select_features: bool = True):
    """Importance-based selection, then L2 logistic regression with balanced
    class weights, fitted on the training rows."""
    train = with_class_weight(split_df.where("split = 'train'"))
    sum_w = train.agg(F.sum("weight")).first()[0]
    return fit_staged(classifier_pipeline(logistic(C, sum_w), select_features), train, N_PREP)


def fit_tree_classifier(split_df: DataFrame, max_depth: int = 19, max_bins: int = 64):
    train = with_class_weight(split_df.where("split = 'train'"))
    est = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                 maxDepth=max_depth, maxBins=max_bins, seed=SEED)
    return fit_staged(classifier_pipeline(est), train, N_PREP)


def positive_weight(split_df: DataFrame, label: str = "label") -> DataFrame:
    """Row weight: int(neg / pos) for positives, 1 for negatives (training rows)."""
    train = split_df.where("split = 'train'")
    r = train.agg(F.floor(F.sum(1 - F.col(label)) / F.sum(F.col(label))).alias("_r"))
    return train.withColumn(
        "weight", F.when(F.col(label) == 1, scalar(r, "_r").cast("double")).otherwise(1.0))


def boosted_classifier(**params) -> BoostedTrees:
    return BoostedTrees(featuresCol="features", labelCol="label", weightCol="weight", objective="logistic",
                        seed=SEED, **{**BOOSTED_CLASSIFIER, **params})


def fit_boosted_classifier(split_df: DataFrame, **params):
    return fit_staged(classifier_pipeline(boosted_classifier(**params)), positive_weight(split_df), N_PREP)


def predict_classifier(model, df: DataFrame) -> DataFrame:
    return _with_prob(model.transform(df))


class DepthReader:
    """The trees of every depth in a tree grown to the largest one: Spark decides a split from the node's rows alone,
    so a fit of depth d is the grown tree cut at level d, with sibling leaves of the same prediction merged, as
    Spark merges them. Read from the model's saved nodes."""

    def __init__(self, model, depths: list[int], classify: bool):
        from pyspark.sql import SparkSession
        from innsight.session import scratch_path
        spark = SparkSession.active()
        path = scratch_path(spark, "swept-tree")
        model.write().overwrite().save(path)
        value = (F.try_divide(F.get("impurityStats", F.lit(1)), F.aggregate("impurityStats", F.lit(0.0), lambda x, y: x + y))
                 if classify else F.col("prediction"))
        # the nodes of one fitted tree, which the driver holds as the model already
        t = (spark.read.parquet(f"{path}/data").select(
            "id", "leftChild", "rightChild", "prediction", "split.featureIndex", value.alias("value"),
            F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).toPandas().sort_values("id"))
        if list(t["id"]) != list(range(len(t))):
            raise ValueError("a saved tree numbers its nodes from 0")
        left, right = t["leftChild"].to_numpy(), t["rightChild"].to_numpy()
        self.leaf = left < 0
        here = np.arange(len(t))
        self.left, self.right = np.where(self.leaf, here, left), np.where(self.leaf, here, right)
        self.feature = np.where(self.leaf, 0, t["featureIndex"].to_numpy())
        self.threshold, self.value = t["threshold"].to_numpy(dtype=float), t["value"].to_numpy(dtype=float)
        level, levels = np.zeros(len(t), dtype=np.int64), [np.array([0])]
        while len(inner := levels[-1][~self.leaf[levels[-1]]]):
            levels.append(np.concatenate([self.left[inner], self.right[inner]]))
            level[levels[-1]] = len(levels) - 1
        self.depths, self.steps = list(depths), min(max(depths), len(levels) - 1)
        self.shown = [self._shown(d, level, levels, t["prediction"].to_numpy()) for d in self.depths]

    def _shown(self, depth: int, level, levels, prediction) -> np.ndarray:
        """The node that stands for each node in the tree of that depth."""
        leaf = self.leaf | (level >= depth)
        for nodes in reversed(levels[:depth]):
            inner = nodes[~leaf[nodes]]
            l, r = self.left[inner], self.right[inner]  # noqa: E741
            leaf[inner] = leaf[l] & leaf[r] & (prediction[l] == prediction[r])
        shown = np.arange(len(leaf))
        for nodes in levels:
            inner = nodes[~self.leaf[nodes]]
            for child in (self.left[inner], self.right[inner]):
                shown[child] = np.where(leaf[inner], shown[inner], child)
                leaf[child] |= leaf[inner]
        return shown

    def values(self, x: np.ndarray) -> np.ndarray:
        """[row, depth]: the value of each row in the tree of each depth."""
        rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for _ in range(self.steps):
            with np.errstate(invalid="ignore"):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return np.stack([self.value[s[node]] for s in self.shown], axis=1)

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """A row for each depth: ``max_depth`` and the value as ``name``."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def read(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.values(np.stack(x.to_numpy()))) if len(x) else [])
        values = F.pandas_udf(read, "array<double>")(vector_to_array(F.col("features")))
        return (df.withColumn("_v", values).withColumn("_d", F.array(*[F.lit(d) for d in self.depths]))
                .withColumn("_at", F.explode(F.arrays_zip("_d", "_v")))
                .withColumns({"max_depth": F.col("_at._d"), name: F.col("_at._v")}).drop("_v", "_d", "_at", "features"))


def depth_sweep_classifier(split_df: DataFrame, depths=range(1, 21), threshold: float = 0.5) -> DataFrame:
    """Train/val accuracy and F1 of a balanced tree for each depth; the
    preprocessing is fitted once and the vectors cached, one tree of the largest
    depth is grown and read at every depth (``DepthReader``)."""
    from innsight.operators.evaluate import confusion_metrics
    weighted = with_class_weight(split_df.where(F.col("split").isin("train", "val")))
    train = weighted.where("split = 'train'")
    prep = Pipeline(stages=preprocessing_stages("cancellation") + [PrefixAssembler()]).fit(train)
    vec = prep.transform(spread(weighted)).select("features", "label", "weight", "split").cache()
    deepest = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                     maxDepth=max(depths), maxBins=64, seed=SEED).fit(vec.where("split = 'train'"))
    met = confusion_metrics(DepthReader(deepest, list(depths), True).add(vec, "prob"), threshold, by=["max_depth", "split"])
    rows = met.select("max_depth", "split", "accuracy", "f1").collect()
    vec.unpersist()
    spark = split_df.sparkSession
    long = spark.createDataFrame(rows, "max_depth int, split string, accuracy double, f1 double")
    return (long.groupBy("max_depth").pivot("split", ["train", "val"])
            .agg(F.first("accuracy").alias("accuracy"), F.first("f1").alias("f1")))


def best_depth(sweep: DataFrame, column: str = "val_f1", maximize: bool = True) -> int:
    """First depth with the best value (ties -> smallest depth)."""
    order = F.desc(column) if maximize else F.asc(column)
    return int(sweep.orderBy(order, F.asc("max_depth")).first()["max_depth"])


# ---------------------------------------------------------------------------
# random search with cross-validation
# ---------------------------------------------------------------------------

# fixed values: the search space of the study (trees, depth, learning rate, row
# and column samples, least hessian of a child, least gain, L1, L2)
CLASSIFIER_SPACE = {
    "maxIter": [100, 200, 300, 400, 500],
    "maxDepth": [3, 4, 5, 6, 7],
    "stepSize": [0.01, 0.05, 0.08, 0.1, 0.15, 0.2],
    "subsamplingRate": [0.6, 0.7, 0.8, 0.9, 1.0],
    "columnRate": [0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
    "minChildWeight": [1.0, 3.0, 5.0, 7.0, 10.0],
    "minSplitGain": [0.0, 0.05, 0.1, 0.2, 0.3],
    "l1": [0.0, 0.01, 0.1, 0.5, 1.0],
    "l2": [0.5, 1.0, 1.5, 2.0, 3.0],
}
REGRESSOR_SPACE = dict(CLASSIFIER_SPACE)


def sample_params(space: dict, n_iter: int, seed: int = SEED) -> list[dict]:
    """``n_iter`` seeded draws from the grid, all different (all of the grid if it is smaller)."""
    keys = sorted(space)
    size = math.prod(len(space[k]) for k in keys)
    out = []
    for at in random.Random(seed).sample(range(size), min(n_iter, size)):
        draw = {}
        for k in keys:
            at, i = divmod(at, len(space[k]))
            draw[k] = space[k][i]
        out.append(draw)
    return out


def fold_column(df: DataFrame, k: int = 5, strata: str | None = "label",
                id_col: str = "Booking_ID", seed: int = SEED) -> DataFrame:
    """Fold id 0..k-1 per row: round-robin over the hash order inside each
    stratum, so every fold keeps the class mix (exact within one row).
    The rank inside a stratum uses the distributed prefix sums, not a
    single-task window."""
    from innsight.operators.ranks import segmented_prefix_sums
    from innsight.operators.split import hash_key
    key = hash_key(id_col, seed + 1)
    s = F.col(strata) if strata else F.lit(0)
    keyed = df.withColumn("_key", key).withColumn("_s", s).withColumn("_one", F.lit(1))
    ranked = segmented_prefix_sums(keyed, ["_s"], ["_key"], ["_one"])
    return (ranked.withColumn("fold", (F.col("_one_before") % k).cast("int"))
            .drop("_key", "_s", "_one", "_one_before"))


def cross_validate(train: DataFrame, make_estimator, params: list[dict], k: int = 5,
                   metric: str = "roc_auc", parallelism: int = 4, kind: str = "classifier",
                   ledger: str | None = None, side_by_side: bool = True) -> DataFrame:
    """Mean and std of the validation metric of each configuration over k folds.

    Preprocessing is fitted once per fold (on its training rows), its vectors are
    shared by all configurations. Where a fold's fitting rows are within the
    booster's ``nodeRows``, its rows are binned once and every (draw, fold) is a task of
    its own, all draws side by side; larger folds are fitted one after the other,
    each distributed (thread pool, also for ``side_by_side=False``). The values are the same.

    ``ledger``: a folder in which every draw's fold values are appended as soon as
    they are known (a committed folder per draw); a search that finds its own rows
    there fits only what is missing. One row per configuration: its parameters
    as typed columns, the metric, and a rank in which equal means share the smallest place."""
    import statistics
    classify = kind == "classifier"
    label = "label" if classify else "avg_price_per_room"
    columns = ["features", label] + (["weight"] if classify else [])
    key = search_key(params, k, metric, kind)
    known = read_ledger(train.sparkSession, ledger, key)
    values = {i: known[i] for i in range(len(params)) if len(known.get(i, {})) == k}
    missing = [i for i in range(len(params)) if i not in values]
    folded = fold_column(train, k, "label" if classify else None) if missing else None
    held_rows, folds = [], []
    try:
        for f in range(k if missing else 0):
            stages = preprocessing_stages("cancellation" if classify else "price") + [PrefixAssembler()]
            prep = Pipeline(stages=stages).fit(folded.where(F.col("fold") != f))
            held_rows.append([prep.transform(folded.where(c)).select(*columns).cache()
                              for c in (F.col("fold") != f, F.col("fold") == f)])
            folds.append([packed(d) for d in held_rows[-1]])
        one = (_side_by_side if side_by_side and folds and all(
            d.count() <= make_estimator(params[0]).getOrDefault("nodeRows") for d, _ in folds) else _one_by_one)(
                folds, make_estimator, params, metric, label, classify)

        def recorded(i):
            got = one(i)
            write_ledger(train.sparkSession, ledger, key, i, params[i], got)
            return i, got
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            values.update(pool.map(recorded, sorted(missing, key=lambda i: -_cost(params[i]))))
    finally:
        for pair in held_rows:
            for d in pair:
                d.unpersist()
    higher = metric in ("roc_auc", "r2")
    folds_of = [[values[i][f] for f in range(k)] for i in range(len(params))]
    means = [statistics.fmean(v) for v in folds_of]
    rows = [(i, *params[i].values(), m, statistics.pstdev(folds_of[i]),
             1 + sum((x > m) if higher else (x < m) for x in means)) for i, m in enumerate(means)]
    types = {int: "int", float: "double", str: "string"}
    names = ", ".join(f"{n} {types[type(v)]}" for n, v in params[0].items())
    return train.sparkSession.createDataFrame(
        rows, f"config int, {names}, mean_{metric} double, std_{metric} double, rank int")


def _cost(p: dict) -> float:
    """Long fits first, so that the last tasks are short."""
    return p.get("maxIter", 1) * p.get("maxDepth", 1)


def _one_by_one(folds, make_estimator, params, metric, label, classify):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
    evaluator = (BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="probability",
                                               metricName="areaUnderROC", numBins=0)
                 if classify else RegressionEvaluator(labelCol=label, metricName=metric))

    def one(i: int) -> dict[int, float]:
        return {f: float(evaluator.evaluate(make_estimator(params[i]).fit(fit).transform(hold)))
                for f, (fit, hold) in enumerate(folds)}
    return one


def _side_by_side(folds, make_estimator, params, metric, label, classify):
    first = make_estimator(params[0])
    shared = [Fold(fit, hold, first._values(), "weight" if classify else None) for fit, hold in folds]
    sc = folds[0][0].sparkSession.sparkContext

    def one(i: int) -> dict[int, float]:
        p = make_estimator(params[i])._values()
        tasks = [r for f, fold in enumerate(shared) for r in fold.values({i: p}, f)]
        return {f: v for _, f, v in sc.union(tasks).collect()}
    return one


# ---- the ledger of a search ----

LEDGER = "fold int, value double, params_json string, search string, config int"


def search_key(params: list[dict], k: int, metric: str, kind: str) -> str:
    """Names the rows of one search: other draws, folds or metrics are another search."""
    text = json.dumps([params, k, metric, kind], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def read_ledger(spark, path: str | None, key: str) -> dict[int, dict[int, float]]:
    """{config: {fold: value}} of the search's committed rows; nothing where the folder is not there yet."""
    if path is None:
        return {}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    out: dict[int, dict[int, float]] = {}
    # draws x folds rows of one search
    for r in spark.read.schema(LEDGER).parquet(path).where(F.col("search") == key).collect():
        out.setdefault(r["config"], {})[r["fold"]] = r["value"]
    return out


def write_ledger(spark, path: str | None, key: str, config: int, params: dict, values: dict[int, float]) -> None:
    """A folder for each draw, so draws that end together don't meet; committed as a whole, written again as it was."""
    if path is not None:
        rows = [(f, v, json.dumps(params, sort_keys=True)) for f, v in sorted(values.items())]
        (spark.createDataFrame(rows, LEDGER.split(", search")[0]).coalesce(1).write.mode("overwrite")
         .parquet(f"{path}/search={key}/config={config}"))


def best_params(results: DataFrame) -> dict:
    """Parameters of the best configuration (rank 1; ties: the first draw)."""
    r = results.orderBy("rank", "config").first().asDict()
    return {n: v for n, v in r.items() if n in CLASSIFIER_SPACE}


def best_params_table(results: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """(param, value) of the best configuration and its cross-validated metric."""
    r = results.orderBy("rank", "config").first()
    rows = [(n, str(v)) for n, v in best_params(results).items()]
    return results.sparkSession.createDataFrame(
        rows + [(f"cv_{metric}", repr(round(r[f"mean_{metric}"], 4)))], "param string, value string")


def refit_best_classifier(split_df: DataFrame, results: DataFrame):
    """The best draw, fitted on all training rows."""
    return fit_boosted_classifier(split_df, **best_params(results))


def refit_best_regressor(price_split: DataFrame, results: DataFrame, transform: str = "raw"):
    return fit_boosted_regressor(price_split, transform, **best_params(results))


def random_search_classifier(split_df: DataFrame, n_iter: int = 30, k: int = 5, parallelism: int = 4,
                             space: dict = CLASSIFIER_SPACE, **kw) -> DataFrame:
    """Seeded random search over the boosted classifier, stratified k-fold
    ROC AUC on the (positively weighted) training rows."""
    params = sample_params(space, n_iter)
    return cross_validate(positive_weight(split_df), lambda p: boosted_classifier(**p), params, k,
                          "roc_auc", parallelism, "classifier", **kw)


def search_results_top(results: DataFrame, metric: str = "roc_auc", k: int = 10) -> DataFrame:
    """The top-k configurations (a top-k report)."""
    return results.orderBy("rank", "config").limit(k)


# ---------------------------------------------------------------------------
# regressors
# ---------------------------------------------------------------------------

def regressor_pipeline(estimator) -> Pipeline:
    return Pipeline(stages=preprocessing_stages("price") + [PrefixAssembler(), estimator])


def ridge(alpha: float, y_std: float, n: int, label: str = "avg_price_per_room") -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol=label, elasticNetParam=0.0,
                            regParam=alpha * y_std / max(n, 1), standardization=False,
                            solver="l-bfgs", maxIter=1000, tol=1e-10)


def with_target(df: DataFrame, transform: str = "log1p", target: str = "avg_price_per_room",
                out: str = "y") -> DataFrame:
    y = F.log1p(F.col(target)) if transform == "log1p" else F.col(target)
    return df.withColumn(out, y)


def fit_ridge(price_split: DataFrame, alpha: float = 10.0, transform: str = "log1p"):
    train = with_target(price_split.where("split = 'train'"), transform)
    s = train.agg(F.stddev_samp("y").alias("sd"), F.count(F.lit(1)).alias("n")).first()
    return fit_staged(regressor_pipeline(ridge(alpha, s["sd"], s["n"], "y")), train, N_PREP)


def fit_tree_regressor(price_split: DataFrame, max_depth: int = 12, transform: str = "log1p"):
    train = with_target(price_split.where("split = 'train'"), transform)
    est = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=max_depth,
                                maxBins=64, seed=SEED)
    return fit_staged(regressor_pipeline(est), train, N_PREP)


def boosted_regressor(label: str = "y", **params) -> BoostedTrees:
    return BoostedTrees(featuresCol="features", labelCol=label, objective="squared", seed=SEED,
                        **{**BOOSTED_REGRESSOR, **params})


def fit_boosted_regressor(price_split: DataFrame, transform: str = "raw", **params):
    train = with_target(price_split.where("split = 'train'"), transform)
    return fit_staged(regressor_pipeline(boosted_regressor("y", **params)), train, N_PREP)


def predict_price(model, df: DataFrame, transform: str) -> DataFrame:
    """Prediction back in price units (expm1 when trained on log1p), >= 0."""
    out = model.transform(df)
    p = F.expm1("prediction") if transform == "log1p" else F.col("prediction")
    return out.withColumn("predicted_price", F.greatest(F.lit(0.0), p))


def depth_sweep_regressor(price_split: DataFrame, depths=range(1, 21), transform: str = "log1p") -> DataFrame:
    """Train/val RMSE in price units per depth and their gap; one tree of the largest depth is read at every depth."""
    from innsight.operators.evaluate import regression_metrics
    rows = with_target(price_split.where(F.col("split").isin("train", "val")), transform)
    prep = Pipeline(stages=preprocessing_stages("price") + [PrefixAssembler()]).fit(
        rows.where("split = 'train'"))
    vec = prep.transform(spread(rows)).select("features", "y", "avg_price_per_room", "split").cache()
    deepest = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=max(depths), maxBins=64,
                                    seed=SEED).fit(vec.where("split = 'train'"))
    p = F.expm1("prediction") if transform == "log1p" else F.col("prediction")
    pr = DepthReader(deepest, list(depths), False).add(vec, "prediction").select(
        "max_depth", "split", F.col("avg_price_per_room").alias("actual"), p.alias("predicted"))
    got = regression_metrics(pr, by=["max_depth", "split"]).select("max_depth", "split", "rmse").collect()
    vec.unpersist()
    spark = price_split.sparkSession
    long = spark.createDataFrame(got, "max_depth int, split string, rmse double")
    wide = long.groupBy("max_depth").pivot("split", ["train", "val"]).agg(F.first("rmse"))
    return (wide.withColumnRenamed("train", "train_rmse").withColumnRenamed("val", "val_rmse")
            .withColumn("gap", F.col("val_rmse") - F.col("train_rmse")))


def random_search_regressor(price_split: DataFrame, n_iter: int = 30, k: int = 5, parallelism: int = 4,
                            space: dict = REGRESSOR_SPACE, **kw) -> DataFrame:
    """Seeded random search over the boosted regressor, plain k-fold RMSE."""
    params = sample_params(space, n_iter)
    train = price_split.where("split = 'train'")
    return cross_validate(train, lambda p: boosted_regressor("avg_price_per_room", **p), params, k,
                          "rmse", parallelism, "regressor", **kw)


def compare_targets(price_split: DataFrame, make_model, parallelism: int = 2) -> tuple[DataFrame, dict]:
    """Validation RMSE in price units for a raw and a log1p target; the lower
    one is chosen (``chosen`` = true on that row). Returns the table and the
    fitted models by target, so the chosen one needs no further fit."""
    from innsight.operators.evaluate import regression_metrics
    val = price_split.where("split = 'val'")
    targets = ("raw", "log1p")
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        models = dict(zip(targets, pool.map(lambda t: make_model(price_split, t), targets)))
    spark = price_split.sparkSession

    def measured(t: str) -> tuple[str, float]:
        pr = predict_price(models[t], val, t).select(F.col("avg_price_per_room").alias("actual"),
                                                     F.col("predicted_price").alias("predicted"))
        return t, float(regression_metrics(pr, by=[]).first()["rmse"])
    rows = side_by_side(spark, *[lambda t=t: measured(t) for t in targets])
    best = min(rows, key=lambda r: (r[1], r[0] != "raw"))[0]
    table = spark.createDataFrame(
        [(t, r, t == best) for t, r in rows], "target string, val_rmse double, chosen boolean")
    return table, models
