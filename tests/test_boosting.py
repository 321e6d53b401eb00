"""Second-order boosted trees against a plain-Python exact solution, on every plan."""

import math
import threading
import uuid

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from innsight.operators import boosting as B
from innsight.session import scratch_path


def _rows(n=700, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 3] = rng.integers(0, 2, n)
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 3] + rng.normal(size=n) * 0.4 > 0.2).astype(float)
    w = np.where(y == 1, 2.0, 1.0)
    return x, y, w


def _frame(spark, x, y, w, parts=1):
    rows = [([float(v) for v in r], float(a), float(b)) for r, a, b in zip(x, y, w)]
    df = spark.createDataFrame(rows, "x array<double>, label double, weight double")
    return df.select(array_to_vector("x").alias("features"), "label", "weight").repartition(parts).cache()


def _exact_tree(x, g, h, idx, depth, edges, p):
    """Recursive exact growth over the same candidate edges, one row and one candidate at a time."""
    gs, hs = sum(g[i] for i in idx), sum(h[i] for i in idx)
    shrink = lambda a: math.copysign(max(abs(a) - p["l1"], 0.0), a)
    score = lambda a, b: shrink(a) ** 2 / (b + p["l2"])
    leaf = -shrink(gs) / (hs + p["l2"]) * p["stepSize"]
    best = None
    if depth:
        for f in range(x.shape[1]):
            for e in edges[f]:
                left = [i for i in idx if x[i, f] <= e]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if hl < p["minChildWeight"] or hs - hl < p["minChildWeight"]:
                    continue
                gain = score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)
                if best is None or gain > best[0] + 1e-6 * (1 + abs(gain)):
                    best = (gain, f, e, left)
    if best is None or best[0] <= max(p["minSplitGain"], 1e-6):
        return {i: leaf for i in idx}
    right = sorted(set(idx) - set(best[3]))
    return (_exact_tree(x, g, h, best[3], depth - 1, edges, p)
            | _exact_tree(x, g, h, right, depth - 1, edges, p))


@pytest.mark.parametrize("objective", ["logistic", "squared"])
@pytest.mark.parametrize("parts,node_rows", [(1, 10_000), (3, 10_000), (3, 150), (2, 1)])
def test_two_trees_equal_the_exact_solution(spark, objective, parts, node_rows):
    x, y, w = _rows(260)
    target = y if objective == "logistic" else x[:, 0] * 3 + y
    p = dict(stepSize=0.4, l1=0.3, l2=1.5, minChildWeight=2.0, minSplitGain=0.2)
    model = B.BoostedTrees(objective=objective, weightCol="weight", maxIter=2, maxDepth=3, nodeRows=node_rows, maxBins=16,
                           **p).fit(_frame(spark, x, target, w, parts))
    e = B.Ensemble(model.getOrDefault("ensemble"))
    mean = float((target * w).sum() / w.sum())
    prior = math.log(mean / (1 - mean)) if objective == "logistic" else mean
    assert math.isclose(e.prior, prior, rel_tol=1e-9)
    want = np.full(len(y), prior)
    for _ in range(2):
        g, h = B.gradients(objective, want, target, w)
        tree = _exact_tree(x, g.tolist(), h.tolist(), list(range(len(y))), 3, e.edges, p)
        want = want + np.array([tree[i] for i in range(len(y))])
    assert np.allclose(e.score(x), want, atol=1e-9)


def test_every_plan_grows_the_same_trees(spark, monkeypatch):
    """Histograms of big nodes, rows of small ones, one partition or several, samples and refreshed scores."""
    monkeypatch.setattr(B, "REFRESH", 4)
    monkeypatch.setattr(B, "SHIPPED", 3)
    x, y, w = _rows(900, 2)
    x[::50, 1] = np.nan                    # missing values: the last bin
    df = _frame(spark, x, y, w, 3)
    got = []
    for node_rows in (10_000, 200, 1):
        m = B.BoostedTrees(weightCol="weight", maxIter=10, maxDepth=4, columnRate=0.75, subsamplingRate=0.7,
                           l1=0.1, l2=2.0, maxBins=32, nodeRows=node_rows).fit(df)
        got.append(B.Ensemble(m.getOrDefault("ensemble")))
    for e in got[1:]:
        assert (e.feature == got[0].feature).all() and (e.edge == got[0].edge).all()
        assert np.allclose(e.value, got[0].value)


def test_model_scores_saves_and_loads(spark):
    x, y, w = _rows()
    df = _frame(spark, x, y, w, 2)
    m = B.BoostedTrees(weightCol="weight", maxIter=30, maxDepth=3, stepSize=0.3).fit(df)
    path = scratch_path(spark, "booster")
    m.write().overwrite().save(path)
    again = B.BoostedTreesModel.load(path)
    from pyspark.ml.functions import vector_to_array
    a = m.transform(df).select(vector_to_array("probability")[1].alias("p"), "label")
    b = again.transform(df).select(vector_to_array("probability")[1].alias("p"), "label")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.filter("(p >= 0.5) = (label = 1)").count() > 0.85 * len(y)
    assert again.getNumTrees == 30
    imp = again.featureImportances.toArray()
    assert math.isclose(imp.sum(), 1.0) and imp.argmax() == 0
    assert "prediction" in B.BoostedTrees(objective="squared", maxIter=1).fit(df).transform(df).columns


def test_hot_values_constant_columns_and_bad_settings(spark):
    x = np.zeros((300, 2))
    x[:150, 0] = 1.0
    y = x[:, 0].copy()
    m = B.BoostedTrees(maxIter=3, maxDepth=2).fit(_frame(spark, x, y, np.ones(300), 4))
    e = B.Ensemble(m.getOrDefault("ensemble"))
    assert set(e.feature[e.feature >= 0]) == {0}
    assert (e.score(x)[:150] > 0).all() and (e.score(x)[150:] < 0).all()
    assert np.isfinite(e.score(np.array([[np.nan, np.nan]]))).all()
    with pytest.raises(ValueError):
        B.BoostedTrees(maxBins=999).fit(_frame(spark, x, y, np.ones(300)))
    with pytest.raises(ValueError):
        B.BoostedTrees().fit(_frame(spark, x, y, np.ones(300)).filter(F.lit(False)))


def _jobs(spark, work):
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        out = work()
        return out, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_a_fit_do_not_follow_its_trees(spark):
    """A table within nodeRows is one task's fit; a larger one takes at most a job a level."""
    x, y, w = _rows(600, 5)
    df = _frame(spark, x, y, w, 3)
    few, many = (_jobs(spark, lambda n=n: B.BoostedTrees(maxIter=n, maxDepth=3).fit(df))[1] for n in (2, 40))
    assert many <= few
    large = [_jobs(spark, lambda n=n: B.BoostedTrees(maxIter=n, maxDepth=3, nodeRows=50).fit(df))[1] for n in (2, 12)]
    assert large[1] - large[0] <= 10 * 3


@pytest.mark.parametrize("levels", [1, 2])
def test_deep_nodes_finished_by_one_task_grow_the_same_trees(spark, monkeypatch, levels):
    x, y, w = _rows(900, 6)
    df = _frame(spark, x, y, w, 3)
    fit = lambda rows: B.Ensemble(B.BoostedTrees(
        weightCol="weight", maxIter=4, maxDepth=5, nodeRows=rows, subsamplingRate=0.8).fit(df).getOrDefault("ensemble"))
    whole = fit(10_000)
    monkeypatch.setattr(B, "HISTOGRAM_LEVELS", levels)
    parts = fit(400)
    assert (parts.feature == whole.feature).all() and (parts.edge == whole.edge).all()
    assert np.allclose(parts.value, whole.value)


def test_features_that_share_a_byte_keep_their_histograms():
    rng = np.random.default_rng(0)
    sizes = [2, 64, 1, 5, 2, 255, 7, 3, 2, 2]
    bins = np.stack([rng.integers(0, s, 500) for s in sizes], axis=1).astype(np.uint8)
    packing = B.Packing([np.arange(s - 1, dtype=float) for s in sizes])
    codes, g = packing.codes(bins), rng.normal(size=500)
    assert len(codes) < len(sizes)
    node, columns = rng.integers(0, 3, 500), np.array([0, 1, 2, 4, 5, 7, 9])
    got = packing.by_feature(packing.histograms(codes, columns, node * B.CODES, 3, (g, None)), columns)
    for i, f in enumerate(columns):
        for n in range(3):
            mine = node == n
            assert np.allclose(got[0, n, i], np.bincount(bins[mine, f], weights=g[mine], minlength=255))
            assert (got[1, n, i] == np.bincount(bins[mine, f], minlength=255)).all()


def test_features_that_exclude_each_other_share_few_bytes():
    """One-hot and derived features: as many codes as the rows have combinations, not as their bins allow."""
    rng = np.random.default_rng(3)
    month = rng.integers(0, 12, 4000)
    x = np.concatenate([np.eye(12)[month], (month // 3)[:, None], np.eye(4)[month // 3], rng.integers(0, 200, (4000, 1))],
                       axis=1)
    sizes = [2] * 12 + [4] + [2] * 4 + [200]
    packing = B.Packing([np.arange(s - 1, dtype=float) for s in sizes])
    bins = x.astype(np.uint8)
    bundles, codes = packing.bundled(packing.codes(bins))
    assert len(packing.used) == 4 and sorted(bundles.used) == [12, len(np.unique(bins[:, 17]))]
    for f in range(bins.shape[1]):
        assert (bundles.bin[f][codes[bundles.code[f]]] == bins[:, f]).all()
    g, rows, columns = rng.normal(size=4000), np.flatnonzero(rng.random(4000) < 0.5), np.array([0, 5, 12, 16, 17])
    got = bundles.by_feature(bundles.sums(codes, columns, B.paired(g, np.ones(4000)), rows)[:, None], columns)
    for i, f in enumerate(columns):
        assert np.allclose(got[0, 0, i], np.bincount(bins[rows, f], weights=g[rows], minlength=200))
        assert (got[1, 0, i] == np.bincount(bins[rows, f], minlength=200)).all()
    left, right = bundles.parted(codes, rows, 12, 1)
    assert (left == rows[bins[rows, 12] <= 1]).all() and (right == rows[bins[rows, 12] > 1]).all()


def test_combinations_that_fill_no_byte_stay_apart():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 60, (9000, 4)).astype(np.uint8)
    packing = B.Packing([np.arange(59, dtype=float)] * 4)
    bundles, codes = packing.bundled(packing.codes(bins))
    assert len(bundles.used) == 4 and all(
        (bundles.bin[f][codes[bundles.code[f]]] == bins[:, f]).all() for f in range(4))


def test_queries_on_both_production_models_fit_them_side_by_side(spark, monkeypatch):
    from innsight.plans import model_queries as Q
    both = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(Q, "_splits", lambda *_: None)
    monkeypatch.setattr(Q, "_prices", lambda *_: None)
    fitted = []

    def fit(name):
        both.wait()                      # broken unless the other fit runs at the same time
        fitted.append(name)
        return {"name": name}
    monkeypatch.setattr(Q.FZ, "finalize_cancellation", lambda _: fit("classifier"))
    monkeypatch.setattr(Q.FZ, "finalize_price", lambda _: fit("regressor"))
    where = f"none-{uuid.uuid4().hex}"
    assert [m["name"] for m in Q.both_final(spark, where)] == ["classifier", "regressor"]
    assert Q.both_final(spark, where)[0] is Q.clf_final(spark, where) and len(fitted) == 2


def test_candidates_are_the_best_splits_of_the_histograms():
    """More than eight bytes of codes, all rows or some, drawn columns: sums and splits as by feature."""
    rng = np.random.default_rng(8)
    sizes = [64, 2, 60, 5, 62, 64, 1, 63, 64, 3, 61, 64, 64, 64]
    bins = np.stack([rng.integers(0, s, 40_000) for s in sizes], axis=1).astype(np.uint8)
    packing = B.Packing([np.arange(s - 1, dtype=float) for s in sizes])
    codes, gh = packing.codes(bins), B.paired(rng.normal(size=40_000), rng.random(40_000))
    assert len(codes) > 8
    columns, p = np.array([0, 1, 3, 4, 6, 9, 11, 13]), dict(l1=0.1, l2=1.0, minChildWeight=1.0)
    hist = np.stack([packing.sums(codes, columns, gh, np.flatnonzero(bins[:, 3] == v), B.wide(codes)) for v in range(5)], axis=1)
    assert np.allclose(hist.sum(axis=1), packing.sums(codes, columns, gh, None))
    got, want = B.Candidates(packing, columns).best(hist, p), B.best_splits(*packing.by_feature(hist, columns), p)
    assert np.allclose(got[0], want[0]) and (got[1] == columns[want[1]]).all() and (got[2] == want[2]).all()
    assert all(np.allclose(got[3][k], want[3][k]) for k in want[3])
    tree = B.Tree(2)
    tree.feature[:3], tree.edge[:3] = [0, 4, 11], [30, 20, 40]
    side = lambda f, e: (bins[:, f] > e).astype(int)
    left = side(0, 30) == 0
    assert (packing.route(tree, codes) == np.where(left, 3 + side(4, 20), 5 + side(11, 40))).all()
    score, rows = np.zeros(40_000), np.flatnonzero(left)
    packing.landed(score, codes, rows, 4, 20, (1.0, 2.0))
    assert (score == np.where(left, 1.0 + side(4, 20), 0.0)).all()


@pytest.mark.parametrize("price", [False, True])
def test_baselines_are_measured_beside_the_fit(spark, monkeypatch, price):
    """The fit is one task: what doesn't need its trees doesn't wait for them."""
    from innsight.operators import finalize as FZ
    both = threading.Barrier(2, timeout=20)

    class Fitted(Exception):
        pass

    def fit(*_, **__):
        both.wait()                      # broken unless the baseline is measured at the same time
        raise Fitted
    monkeypatch.setattr(FZ.M, "compare_targets" if price else "fit_boosted_classifier", fit)
    name = "fit_dummy_regressor" if price else "fit_dummy_classifier"
    dummy = getattr(FZ.M, name)
    monkeypatch.setattr(FZ.M, name, lambda df: (both.wait(), dummy(df))[1])
    rows = [(f"b{i}", i % 2, ("train", "val", "test")[i % 3], float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "Booking_ID string, label int, split string, avg_price_per_room double")
    with pytest.raises(Fitted):
        (FZ.finalize_price if price else FZ.finalize_cancellation)(df)


def test_rows_for_a_costly_step_lie_over_all_cores(spark):
    from innsight.operators import models as M
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(0, cores * M.ROWS_PER_PARTITION, 1, 1)
    assert M.over_cores(few).rdd.getNumPartitions() == cores and M.over_cores(few).count() == few.count()
    small, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 3 * cores)
    assert M.over_cores(small) is small and M.over_cores(many) is many


def test_edges_of_counted_features_are_their_quantiles(spark, monkeypatch):
    """Counted over several tasks, empty ones too, or summarised: the same edges; only the latter take a percentile each."""
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, 2, 900), rng.integers(0, 90, 900), np.round(rng.normal(size=900), 1),
                  np.zeros(900)], axis=1).astype(float)
    x[::40, 2] = np.nan
    df = _frame(spark, x, x[:, 0], np.ones(900), 4).where("label >= 0").repartition(7, F.lit(1))
    summarised = []
    plain = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: summarised.append(1) or plain(*a))
    counted = B.bin_edges(df, "features", 4, 32)
    assert not summarised
    monkeypatch.setattr(B, "COUNTED", 50)
    mixed = B.bin_edges(df, "features", 4, 32)
    assert 1 <= len(summarised) < 4
    monkeypatch.setattr(B, "COUNTED", 0)
    approx = B.bin_edges(df, "features", 4, 32)
    for j in range(4):
        assert list(counted[j]) == list(mixed[j]) == list(approx[j])
        v = np.sort(x[:, j])                        # missing values last
        want = np.unique(v[np.ceil(np.arange(1, 32) / 32 * len(v)).astype(int) - 1])
        assert list(counted[j]) == list(want[~np.isnan(want)])


def test_counts_give_the_edges_of_the_summary(spark, monkeypatch):
    """Beyond 5,000 rows the summary errs: where a quantile lies next to another value, the summary is asked."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 2, 12_000), np.arange(12_000) >= 6_000, rng.integers(0, 444, 12_000),
                  rng.integers(0, 12, 12_000)], axis=1).astype(float)
    df = _frame(spark, x[rng.permutation(12_000)], x[:, 0], np.ones(12_000), 5)
    summarised = []
    plain = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: summarised.append(1) or plain(*a))
    got = B.bin_edges(df, "features", 4, 64)
    assert 1 <= len(summarised) < 4
    monkeypatch.setattr(B, "COUNTED", 0)
    want = B.bin_edges(df, "features", 4, 64)
    assert [list(e) for e in got] == [list(e) for e in want]
    assert B.sure_edges(np.array([0.0, 1.0]), np.array([6_000, 6_000]), np.array([0.5])) is None
    assert list(B.sure_edges(np.array([0.0, 1.0]), np.array([6_100, 5_900]), np.array([0.5, 0.9]))) == [0.0, 1.0]


def test_a_level_writes_its_rows_to_memory_that_trees_share():
    """Rows by node stand in the arrays given, in their order, and trees don't differ for it."""
    rng = np.random.default_rng(3)
    packing = B.Packing([np.arange(9.0), np.arange(4.0)])
    codes = packing.codes(np.stack([rng.integers(0, 10, 40_000), rng.integers(0, 5, 40_000)], axis=1).astype(np.uint8))
    rows, out = np.flatnonzero(rng.random(40_000) < 0.8), np.empty(40_000, dtype=np.int64)
    left, right = packing.parted(codes, rows, 0, 4, out)
    assert left.base is out and right.base is out
    goes = (packing.bin[0] > 4)[codes[packing.code[0], rows]]
    assert (left == rows[~goes]).all() and (right == rows[goes]).all()


def test_walks_through_trees_end_at_their_leaves():
    """A tree's look-ups against a walk of every row alone, over several chunks; the highest bin and a tree of one leaf."""
    rng = np.random.default_rng(4)
    bins = rng.integers(0, 255, (3, 20_000)).astype(np.uint8)
    tree = B.Tree(4)
    tree.feature[[0, 1, 2, 5, 11]], tree.edge[[0, 1, 2, 5, 11]] = [0, 1, 2, 0, 1], [100, 50, 253, 200, 7]
    want = []
    for row in bins.T:
        node = 0
        while tree.feature[node] >= 0:
            node = 2 * node + 1 + int(row[tree.feature[node]] > tree.edge[node])
        want.append(node)
    assert list(B.leaves(tree.feature, tree.edge, bins)) == want
    assert not B.leaves(B.Tree(4).feature, B.Tree(4).edge, bins).any()


def test_blocks_are_led_on_from_what_the_worker_knows(monkeypatch):
    """Scores and nodes of a block are the same from the worker's cache, at any level, as from the start."""
    rng = np.random.default_rng(9)
    packing = B.Packing([np.arange(20.0), np.arange(1.0), np.arange(40.0)])
    bins = np.stack([rng.integers(0, n, 3000) for n in (21, 2, 41)], axis=1).astype(np.uint8)
    y, w = (rng.random(3000) < 0.3).astype(float), np.where(rng.random(3000) < 0.5, 2.0, 1.0)
    block = B.Block((0, 0), packing.codes(bins), y, w, np.full(3000, -0.5))
    p = B.BoostedTrees(maxIter=3, maxDepth=4)._values()
    trees, score = B.grown_in_task([block], p, packing, 3)
    small = B.slim(block)
    assert (small.y == y).all() and (small.w == w).all() and len(small.score) == 1 and small.y.dtype == np.uint8
    assert B.narrow(np.array([0.5, 1])).dtype == B.narrow(np.array([300.0, -1])).dtype == np.float64
    monkeypatch.setattr(B, "_SCORES", B.OrderedDict())
    walk = lambda t: B.Walk(packing, t)
    for number, tree in enumerate(trees):
        for level in (0, 1, 1, 3, 2, 4):         # also a level that is asked for again
            part, keep = B.Tree(4), np.arange(len(tree.feature)) < 2 ** level - 1
            part.feature[keep], part.edge[keep] = tree.feature[keep], tree.edge[keep]
            before = trees[:number]
            got = small.reached("fit", before, walk, part)
            want = np.full(3000, -0.5) + sum(t.value[packing.route(t, block.codes)] for t in before)
            assert np.allclose(got[0], want) and (got[1] == packing.route(part, block.codes)).all()
    assert np.allclose(small.reached("fit", trees, walk)[0], score)


def test_blocks_are_dealt_evenly_and_small(spark):
    """Rows of a large fit that lie in one partition are grown by all cores, a byte for a small whole number."""
    seen = []
    real = B._sums
    try:
        B._sums = lambda parts, n: seen.append((n, parts.prev.glom().map(
            lambda bs: [(len(b.y), b.y.dtype.name, b.w.dtype.name) for b in bs]).collect())) or real(parts, n)
        df = spark.range(0, 100_000, 1, 1).selectExpr("cast(id % 2 as double) label", "cast(id % 97 as double) x")
        df = df.select("label", array_to_vector(F.array("x")).alias("features"))
        B.BoostedTrees(maxIter=1, maxDepth=1, nodeRows=1000).fit(df)
    finally:
        B._sums = real
    n, parts = seen[0]
    assert n == spark.sparkContext.defaultParallelism and sum(b[0] for part in parts for b in part) == 100_000
    assert {b[1:] for part in parts for b in part} == {("uint8", "uint8")}
    assert max(map(len, parts)) - min(map(len, parts)) <= 1
