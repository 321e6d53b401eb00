"""Distributed ranks, quantiles and the exact split against brute force."""

import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from innsight.operators.ranks import exact_quantiles, value_ranks
from innsight.operators.split import approximate_mode, assign_split, split_allocation


def test_value_ranks_heavy_ties(spark):
    rnd = random.Random(3)
    vals = [0] * 700 + [rnd.randint(1, 30) for _ in range(300)]  # one value holds 70 % of rows
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r["x"]: r["avg_rank"] for r in value_ranks(df, "x", num_partitions=5).collect()}
    want = pd.Series(vals, dtype=float).rank().groupby(pd.Series(vals, dtype=float)).first()
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-9


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(float(x), x % 2) for x in xs], "v double, g int")
    got = {(r["g"], r["prob"]): r["value"] for r in
           exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0], ["g"], num_partitions=3).collect()}
    for g in set(x % 2 for x in xs):
        arr = np.array([x for x in xs if x % 2 == g], dtype=float)
        for p in (0.0, 0.25, 0.5, 0.75, 1.0):
            assert abs(got[(g, p)] - np.quantile(arr, p)) < 1e-9


def test_allocation_reproduces_published_sizes():
    # 36,238 cleaned rows, 32.78 % canceled -> 21,742 / 7,248 / 7,248
    n, pos = 36238, 11878
    alloc = split_allocation([(0, n - pos), (1, pos)])
    test = sum(t for t, _ in alloc.values())
    val = sum(v for _, v in alloc.values())
    assert (n - test - val, val, test) == (21742, 7248, 7248)
    assert approximate_mode([("a", 5), ("b", 5)], 5) == {"a": 3, "b": 2}


def test_split_is_exact_and_stable(spark):
    rows = [(f"id{i:05d}", int(i % 3 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "Booking_ID string, label int")
    s1 = {r["Booking_ID"]: r["split"] for r in assign_split(df, max_exact_rows=50).collect()}
    s2 = {r["Booking_ID"]: r["split"] for r in assign_split(df.repartition(7)).collect()}
    assert s1 == s2  # independent of partitioning and of the refinement depth
    alloc = split_allocation([(0, 1333), (1, 667)])
    for lab in (0, 1):
        ids = [i for i, y in rows if y == lab]
        assert sum(s1[i] == "test" for i in ids) == alloc[lab][0]
        assert sum(s1[i] == "val" for i in ids) == alloc[lab][1]


def test_segmented_prefix_sums_bruteforce(spark):
    from innsight.operators.ranks import segmented_prefix_sums
    rnd = random.Random(11)
    # one segment holds a third of the rows and spans several range partitions
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 40), i, rnd.randint(0, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "s int, o int, v long")
    got = {r["o"]: r["v_before"] for r in
           segmented_prefix_sums(df, ["s"], ["o"], ["v"], num_partitions=7).collect()}
    run = {}
    for s_, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        assert got[o] == run.get(s_, 0)
        run[s_] = run.get(s_, 0) + v


def test_fold_column_balanced(spark):
    from innsight.operators.models import fold_column
    rows = [(f"b{i:04d}", int(i % 4 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "Booking_ID string, label int")
    got = fold_column(df, k=5).groupBy("fold", "label").count().collect()
    counts = {(r["fold"], r["label"]): r["count"] for r in got}
    assert sorted(counts.values()) == [50] * 5 + [150] * 5


def test_segmented_sums_empty_partitions_and_single_segment(spark):
    from innsight.operators.ranks import prefix_sums, segmented_prefix_sums
    rows = [(1, i, 1) for i in range(40)] + [(2, 0, 5), (3, 0, 7)]
    df = spark.createDataFrame(rows, "s int, o int, v long")
    got = {(r["s"], r["o"]): r["v_before"] for r in
           segmented_prefix_sums(df, ["s"], ["o"], ["v"], num_partitions=64).collect()}
    assert [got[(1, i)] for i in range(40)] == list(range(40))
    assert got[(2, 0)] == 0 and got[(3, 0)] == 0
    flat = {r["o"]: r["v_before"] for r in
            prefix_sums(df.where("s = 1"), ["o"], ["v"], num_partitions=64).collect()}
    assert [flat[i] for i in range(40)] == list(range(40))


def test_segmented_sums_small_batches_two_keys_with_nulls(spark):
    """Segments spanning many Arrow batches and partitions, two key columns,
    null keys (nulls form one segment and sort first)."""
    from innsight.operators.ranks import segmented_prefix_sums
    rnd = random.Random(5)
    rows = []
    for i in range(1200):
        a = None if i % 7 == 0 else (0 if i % 3 == 0 else rnd.randint(1, 6))
        b = None if i % 11 == 0 else rnd.randint(0, 2)
        rows.append((a, b, i, rnd.randint(0, 9)))
    df = spark.createDataFrame(rows, "a int, b int, o int, v long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r["o"]: r["v_before"] for r in
               segmented_prefix_sums(df, ["a", "b"], ["o"], ["v"], num_partitions=5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    run = {}
    for a, b, o, v in rows:  # rows are already in `o` order
        assert got[o] == run.get((a, b), 0), (a, b, o)
        run[(a, b)] = run.get((a, b), 0) + v


def test_quantiles_shuffle_join_branch(spark):
    """Many groups: with a tiny broadcast bound the targets meet the value
    table in shuffle joins; results equal numpy's per group."""
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 30)), rnd.randint(0, 40)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "v double, g int")
    probs = [0.1, 0.5, 0.9]
    q = exact_quantiles(df, "v", probs, ["g"], num_partitions=4, max_broadcast_rows=1)
    got = {(r["g"], r["prob"]): r["value"] for r in q.collect()}
    for g in {g for _, g in rows}:
        arr = np.array([v for v, gg in rows if gg == g])
        for p in probs:
            assert abs(got[(g, p)] - np.quantile(arr, p)) < 1e-9


def test_segmented_sums_two_hot_segments_many_partitions(spark):
    from innsight.operators.ranks import segmented_prefix_sums
    rnd = random.Random(17)
    rows = [(i % 3 if i % 3 < 2 else rnd.randint(2, 30), i, rnd.randint(0, 4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "s int, o int, v long")
    got = {r["o"]: r["v_before"] for r in
           segmented_prefix_sums(df, ["s"], ["o"], ["v"], num_partitions=30).collect()}
    run = {}
    for s_, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
        assert got[o] == run.get(s_, 0)
        run[s_] = run.get(s_, 0) + v


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=0, max_size=60))
def test_global_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["prob"]: r["value"] for r in
           exact_quantiles(df, "v", probs, num_partitions=3).collect()}
    if not xs:
        assert got == {}
        return
    for p in probs:
        assert abs(got[p] - np.quantile(np.array(xs, dtype=float), p)) < 1e-9


def test_bracketed_quantiles_equal_the_exact_ones(spark, monkeypatch):
    import random

    import numpy as np

    from innsight.operators import ranks as R
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), rng.choice([1.0, 1.0, 2.0, None]), float("nan") if i % 9 == 0 else float(i % 3), None)
            for i in range(20_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    seen = []
    inner = R.segmented_prefix_sums
    monkeypatch.setattr(R, "segmented_prefix_sums", lambda x, *a, **k: (seen.append(x.count()), inner(x, *a, **k))[1])
    probs = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    got = {(r["series"], r["prob"]): r["value"] for r in R.bracketed_quantiles(
        df, {c: F.col(c) for c in "abcd"}, probs, accuracy=500).collect()}
    for j, c in enumerate("abc"):
        values = [r[j] for r in rows if r[j] is not None and r[j] == r[j]]
        for p in probs:
            assert abs(got[c, p] - np.quantile(values, p)) < 1e-12, (c, p)
    assert not any(k[0] == "d" for k in got)
    assert seen[0] < 6 * 20_000 * 8 / 500             # distinct doubles: only what lies in the brackets is sorted
    for n in range(1, 12):                            # few rows: neighbours may lie outside the bracket
        few = df.select("a").limit(n)
        values = [r[0] for r in few.collect()]
        got = {r["prob"]: r["value"] for r in R.bracketed_quantiles(
            spark.createDataFrame([(v,) for v in values], "a double"), {"a": F.col("a")}, probs + [0.75, 0.3]).collect()}
        assert all(abs(v - np.quantile(values, p)) < 1e-12 for p, v in got.items()) and len(got) == 8
    assert R.bracketed_quantiles(df.limit(0), {"a": F.col("a")}, [0.5]).count() == 0


def test_exact_rank_test_counts_every_placement(spark):
    from itertools import combinations

    from innsight.operators.profile import exact_u_tail, mann_whitney
    for n1, n2 in ((1, 1), (1, 5), (3, 4), (5, 5), (4, 7)):
        us = [sum(c) - n1 * (n1 - 1) / 2 for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            assert abs(exact_u_tail(n1, n2, u) - sum(x >= u for x in us) / len(us)) < 1e-12
            assert exact_u_tail(n2, n1, u) == exact_u_tail(n1, n2, u)
    frame = lambda a, b: spark.createDataFrame(
        [(float(v), "x") for v in a] + [(float(v), "y") for v in b], "v double, g string")
    test = lambda a, b: mann_whitney(frame(a, b), "v", "g", "x", "y").first()
    # tabled: U = 0 of 3 against 3 is p = 0.1, of 4 against 4 it is 2 / 70
    assert abs(test([1, 2, 3], [4, 5, 6])["p_value"] - 0.1) < 1e-12 and test([1, 2, 3], [4, 5, 6])["method"] == "exact"
    assert abs(test([1, 2, 3, 4], [5, 6, 7, 8])["p_value"] - 2 / 70) < 1e-12
    assert test([1, 2, 2], [2, 5, 6])["method"] == "asymptotic"           # ties
    assert test(range(9), range(20, 29))["method"] == "asymptotic"
    assert test(range(8), range(20, 60))["method"] == "exact"
    assert test([1, 1], [1, 1])["p_value"] == 1.0
    empty = test([], [1, 2])
    assert empty["p_value"] is None and empty["n1"] == 0 and empty["n2"] == 2


def test_hash_split_never_moves_an_old_row(spark):
    from innsight.operators.split import hash_split
    ids = lambda n: spark.range(n).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("Booking_ID"),
                                          (F.col("id") % 3 == 0).cast("int").alias("label"))
    old = {r["Booking_ID"]: r["split"] for r in hash_split(ids(4000)).collect()}
    new = {r["Booking_ID"]: r["split"] for r in hash_split(ids(9000).repartition(7)).collect()}
    assert all(new[k] == v for k, v in old.items())
    for label in (0, 1):                              # every stratum within four standard deviations
        rows = hash_split(ids(9000)).where(F.col("label") == label).groupBy("split").count().collect()
        n = sum(r["count"] for r in rows)
        for r in rows:
            p = {"test": 0.2, "val": 0.2, "train": 0.6}[r["split"]]
            assert abs(r["count"] - p * n) < 4 * (n * p * (1 - p)) ** 0.5
    assert hash_split(spark.createDataFrame([(None, 1)], "Booking_ID string, label int")).first()["split"] == "train"
    other = {r["Booking_ID"]: r["split"] for r in hash_split(ids(4000), seed=7).collect()}
    assert any(other[k] != v for k, v in old.items())
