"""Fitted models: metric floors, probability sanity, metamorphic checks,
persistence, and batch = stream scoring (the study's unit tests, on Spark)."""

import pytest
from pyspark.sql import functions as F

from innsight.operators import evaluate as E
from innsight.operators import models as M
from innsight.operators.audit import as_requests
from innsight.operators import finalize as FZ
from innsight.operators.audit import split_valid, validate_bookings
from innsight.operators.scoring import Scorer, flatten_response
from innsight.plans import model_queries as MQ
from innsight.plans.prepared import price_split_table, split_table
from innsight.sources.bookings import bookings_table
from tests.conftest import SF_MID, SF_SMALL


TREES = 40    # the tests' own models; the registered queries fit the study's 500 and 300 trees


@pytest.fixture(scope="module")
def clf(spark):
    return FZ.finalize_cancellation(split_table(spark, SF_MID), maxIter=TREES)


@pytest.fixture(scope="module")
def reg(spark):
    return FZ.finalize_price(price_split_table(spark, SF_MID), maxIter=TREES)


@pytest.fixture(scope="module")
def scorer(clf, reg):
    return Scorer(clf["model"], reg["model"], clf["meta"], reg["meta"], clf["calibrator"], clf["method"])


def test_classifier_metadata(clf):
    meta = clf["meta"]
    assert 0 < meta["threshold"] < 1
    assert set(meta["risk_bands"]) == {"low", "medium", "high"}
    assert meta["calibration_method"] in ("isotonic", "sigmoid")
    assert meta["n_train_rows"] > 0
    assert len(meta["features_required"]) == 17


def test_classifier_floors(clf):
    m = {r["split"]: r for r in clf["metrics"].collect()}
    assert m["test"]["roc_auc"] > 0.90
    assert m["val"]["f1"] > 0.80


def test_calibration_not_worse_than_raw(clf):
    t = {r["method"]: r["brier_score"] for r in clf["calibration_table"].collect()}
    assert min(t["isotonic"], t["sigmoid"]) <= t["uncalibrated"] + 1e-12


def test_probabilities_in_range(clf):
    r = clf["scored"].agg(F.min("prob_cal"), F.max("prob_cal"), F.min("prob"), F.max("prob")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and 0.0 <= r[2] <= r[3] <= 1.0


def test_risk_archetypes(spark, scorer):
    base = dict(no_of_adults=2, no_of_children=0, no_of_weekend_nights=1, no_of_week_nights=2,
                type_of_meal_plan="Meal Plan 1", required_car_parking_space=0,
                room_type_reserved="Room_Type 1", arrival_year=1996, arrival_month=6, arrival_date=15,
                current_room_price=99.0)
    low = dict(base, Booking_ID="low", lead_time=0, repeated_guest=1, no_of_special_requests=4,
               market_segment_type="Corporate", no_of_previous_cancellations=0,
               no_of_previous_bookings_not_canceled=5)
    high = dict(base, Booking_ID="high", lead_time=400, repeated_guest=0, no_of_special_requests=0,
                market_segment_type="Online", no_of_previous_cancellations=3,
                no_of_previous_bookings_not_canceled=0, current_room_price=200.0)
    from innsight.streaming.score_stream import REQUEST_SCHEMA
    df = spark.createDataFrame([tuple(r[f.name] for f in REQUEST_SCHEMA.fields) for r in (low, high)],
                               REQUEST_SCHEMA)
    got = {r["request_id"]: r for r in scorer.score(df).collect()}
    assert got["low"]["cancellation_probability"] < got["high"]["cancellation_probability"]
    assert got["high"]["cancellation_risk_band"] == "high"
    assert got["low"]["cancellation_risk_band"] == "low"


def test_regressor_floors_and_metadata(reg):
    m = {r["split"]: r for r in reg["metrics"].collect()}
    assert m["test"]["r2"] > 0.70
    assert m["test"]["rmse"] < 25
    assert reg["meta"]["target_transformation"] in ("raw", "log1p")


def test_more_adults_higher_price(spark, reg):
    rows = price_split_table(spark, SF_MID).where("split = 'test'").limit(200)
    one = rows.withColumn("no_of_adults", F.lit(1).cast("long"))
    four = rows.withColumn("no_of_adults", F.lit(4).cast("long"))
    t = reg["transform"]
    p1 = M.predict_price(reg["model"], one, t).agg(F.avg("predicted_price")).first()[0]
    p4 = M.predict_price(reg["model"], four, t).agg(F.avg("predicted_price")).first()[0]
    assert p4 >= p1


def test_price_does_not_depend_on_current_price(spark, scorer):
    req = as_requests(bookings_table(spark, SF_MID)).limit(20)
    a = scorer.score(req).select("request_id", "predicted_room_price")
    b = scorer.score(req.withColumn("current_room_price", F.col("current_room_price") * 3)) \
        .select("request_id", F.col("predicted_room_price").alias("p2"))
    assert a.join(b, "request_id").where("predicted_room_price <> p2").count() == 0


def test_batch_of_ten_and_response_shape(spark, scorer):
    out = scorer.score(as_requests(bookings_table(spark, SF_MID)).limit(10))
    rows = out.collect()
    assert len(rows) == 10
    for r in rows:
        assert r["cancellation_label"] in ("Canceled", "Not_Canceled")
        assert r["cancellation_risk_band"] in ("low", "medium", "high")
        assert r["predicted_room_price"] >= 0
        assert len(r["recommendations"]) >= 1


def test_stream_equals_batch(spark, scorer):
    from innsight.session import scratch_path
    from innsight.streaming.score_stream import run_score_stream, write_requests
    b = bookings_table(spark, SF_MID)
    year = b.agg(F.min("arrival_year")).first()[0]
    src = write_requests(as_requests(b), scratch_path(spark, "in"))
    acc, bad = run_score_stream(spark, src, scorer, scratch_path(spark, "out"), scratch_path(spark, "ckpt"), year)
    ok, rejected = split_valid(validate_bookings(as_requests(b), year))
    stream, batch = flatten_response(acc), flatten_response(scorer.score(ok))
    assert stream.count() == batch.count() > 0
    assert stream.exceptAll(batch).count() == 0
    assert bad.count() == rejected.count() > 0


def test_a_loaded_scorer_scores_like_the_one_in_memory(spark, clf, reg, scorer):
    from innsight.session import scratch_path
    from innsight.sources.tables import save_production, write_run_record
    runs = scratch_path(spark, "runs")
    for fin, kind in ((clf, "classifier"), (reg, "regressor")):
        path = save_production(fin, scratch_path(spark, kind))
        write_run_record(spark, MQ._run_record(fin, path, kind), runs)
    names = clf["meta"]["model_name"], reg["meta"]["model_name"]
    loaded = Scorer.load(spark, runs, *names)
    req = as_requests(bookings_table(spark, SF_MID))
    a, b = flatten_response(scorer.score(req)), flatten_response(loaded.score(req))
    assert a.count() == req.count() and a.exceptAll(b).count() == 0
    with pytest.raises(ValueError, match="nobody"):
        Scorer.load(spark, runs, names[0], "nobody")
    r = spark.read.parquet(runs).where(F.col("kind") == "classifier").first()
    assert r["positive_class"] == "Canceled" and r["trained_on"] and r["n_train_rows"] > 0
    assert r["brier_calibrated"] <= r["brier_uncalibrated"] + 1e-12 and len(r["top_features"]) == 10
    p = spark.read.parquet(runs).where(F.col("kind") == "regressor").first()
    assert p["dummy_baseline"]["test_rmse"] > 0 and set(p["target_comparison"]) == {"raw_rmse", "log1p_rmse"}


def test_importance_is_sorted(clf):
    rows = FZ.feature_importance(clf["model"]).collect()
    values = [r["importance"] for r in rows]
    assert values == sorted(values, reverse=True) and abs(sum(values) - 1) < 1e-6
    assert [r["rank"] for r in FZ.feature_importance(clf["model"], top=3).collect()] == [1, 2, 3]


def test_random_ids_differ_between_batches(spark, scorer):
    req = as_requests(bookings_table(spark, SF_MID)).drop("Booking_ID").limit(20)
    ids = [r["request_id"] for _ in range(2) for r in scorer.score(req, request_id=None).collect()]
    assert len(set(ids)) == 40


def test_search_on_a_small_grid(spark):
    space = {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.1]}
    rows = split_table(spark, SF_SMALL)
    got = M.random_search_classifier(rows, n_iter=10, k=2, space=space)
    assert got.count() == 4                       # all different, and no more than the grid has
    assert dict(got.dtypes)["maxDepth"] == "int" and dict(got.dtypes)["stepSize"] == "double"
    top = M.search_results_top(got, k=3).collect()
    assert [r["rank"] for r in top][0] == 1 and top[0]["mean_roc_auc"] >= top[2]["mean_roc_auc"] > 0.5
    assert set(M.best_params(got)) == set(space)
    assert "cv_roc_auc" in {r["param"] for r in M.best_params_table(got).collect()}
    model = M.refit_best_classifier(rows, got)
    assert model.stages[-1].getNumTrees == M.best_params(got)["maxIter"]
    assert M.random_search_regressor(price_split_table(spark, SF_SMALL), 2, 2, space=space).count() == 2


def test_depth_sweep_and_dummy(spark):
    s = split_table(spark, SF_MID)
    d = M.fit_dummy_classifier(s).transform(s)
    auc = {r["split"]: r["roc_auc"] for r in E.roc_auc(d).collect()}
    assert all(v == 0.5 for v in auc.values())


@pytest.mark.parametrize("kind", ["classifier", "regressor"])
def test_depth_sweep_grows_one_tree_that_equals_a_fit_of_every_depth(spark, kind, monkeypatch):
    from pyspark.ml import Pipeline
    classify = kind == "classifier"
    rows = (split_table if classify else price_split_table)(spark, SF_SMALL)
    depths = [1, 2, 4, 7, 12]
    name = "DecisionTreeClassifier" if classify else "DecisionTreeRegressor"
    tree, fits = getattr(M, name), []
    monkeypatch.setattr(M, name, lambda **k: fits.append(k) or tree(**k))
    got = {r["max_depth"]: r for r in (M.depth_sweep_classifier if classify else M.depth_sweep_regressor)(
        rows, depths).collect()}
    assert len(fits) == 1 and sorted(got) == depths
    both = rows.where("split in ('train', 'val')")
    both = M.with_class_weight(both) if classify else M.with_target(both)
    prep = Pipeline(stages=M.preprocessing_stages("cancellation" if classify else "price") + [M.PrefixAssembler()]).fit(
        both.where("split = 'train'"))
    vec = prep.transform(both).cache()
    for d in depths:
        m = tree(**{**fits[0], "maxDepth": d}).fit(vec.where("split = 'train'"))
        if classify:
            want = E.confusion_metrics(M._with_prob(m.transform(vec)), 0.5)
            names = ("accuracy", "f1")
        else:
            want = E.regression_metrics(m.transform(vec).selectExpr(
                "split", "avg_price_per_room AS actual", "expm1(prediction) AS predicted"))
            names = ("rmse",)
        for r in want.collect():
            for n in names:
                assert got[d][f"{r['split']}_{n}"] == pytest.approx(r[n], rel=1e-12)


def test_a_fits_partitions_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_TASK", 100)
    df = spark.range(1000).coalesce(1)
    out = M.spread(df)
    sizes = out.rdd.glom().map(len).collect()
    assert max(sizes) <= 150 and sorted(r[0] for r in out.collect()) == list(range(1000))
    assert M.spread(spark.range(50).coalesce(1)).rdd.getNumPartitions() == 1
    seen = []
    monkeypatch.setattr(M, "packed", lambda c: seen.append(c.rdd.getNumPartitions()) or c)
    M.fit_ridge(split_table(spark, SF_SMALL).coalesce(1))
    assert seen[0] > 1


def test_target_encodings_are_computed_once(spark):
    from innsight.operators.features import apply_target_encoding, target_encoding
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), (None, "x", 1), ("", "y", 1)], "p string, q string, label int")
    enc, read = target_encoding(rows, ["p", "q"]), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    got = apply_target_encoding(rows, enc.mapInArrow(counted, enc.schema), ["p", "q"]).collect()
    assert read.value == enc.count() == 5
    assert {(r["p"], r["q"]): (r["p_encoded"], r["q_encoded"]) for r in got} == {
        ("a", "x"): (0.5, 1.0), ("a", "y"): (0.5, 0.5), (None, "x"): (None, 1.0), ("", "y"): (1.0, 0.5)}


GRID = {"maxIter": [3, 8], "maxDepth": [2, 4], "stepSize": [0.1, 0.3], "subsamplingRate": [0.7], "columnRate": [0.6],
        "l2": [1.0], "minChildWeight": [3.0]}


@pytest.mark.parametrize("kind", ["classifier", "regressor"])
def test_side_by_side_search_equals_separate_fits(spark, kind):
    search, table, metric = ((M.random_search_classifier, split_table, "roc_auc") if kind == "classifier"
                             else (M.random_search_regressor, price_split_table, "rmse"))
    rows = table(spark, SF_SMALL)
    a, b = (search(rows, n_iter=4, k=3, space=GRID, side_by_side=way).orderBy("config").collect()
            for way in (True, False))
    for x, y in zip(a, b, strict=True):
        assert x["rank"] == y["rank"]
        assert x[f"mean_{metric}"] == pytest.approx(y[f"mean_{metric}"], abs=1e-9)
        assert x[f"std_{metric}"] == pytest.approx(y[f"std_{metric}"], abs=1e-9)


def test_a_search_that_was_killed_goes_on_where_it_stopped(spark, monkeypatch):
    from innsight.session import scratch_path
    rows = split_table(spark, SF_SMALL)
    ledger = scratch_path(spark, "ledger")
    whole = M.random_search_classifier(rows, n_iter=4, k=3, space=GRID).collect()
    done, written = [], M.write_ledger

    def dies(spark_, path, key, config, params, values):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(config)
        written(spark_, path, key, config, params, values)
    monkeypatch.setattr(M, "write_ledger", dies)
    with pytest.raises(KeyboardInterrupt):
        M.random_search_classifier(rows, n_iter=4, k=3, space=GRID, ledger=ledger, parallelism=1)
    fitted = []
    monkeypatch.setattr(M, "write_ledger", lambda s, p, k, c, q, v: (fitted.append(c), written(s, p, k, c, q, v)))
    again = M.random_search_classifier(rows, n_iter=4, k=3, space=GRID, ledger=ledger)
    assert sorted(fitted + done) == [0, 1, 2, 3] and len(fitted) == 2     # only what is missing
    assert again.collect() == whole
    fitted.clear()
    assert M.random_search_classifier(rows, n_iter=4, k=3, space=GRID, ledger=ledger).collect() == whole
    assert not fitted
    # another search in the same folder has rows of its own
    other = M.random_search_classifier(rows, n_iter=2, k=2, space={"maxIter": [2, 3]}, ledger=ledger)
    assert other.count() == 2 and sorted(fitted) == [0, 1]
    key = M.search_key(M.sample_params(GRID, 4), 3, "roc_auc", "classifier")
    assert set(M.read_ledger(spark, ledger, key)) == {0, 1, 2, 3}


def test_every_malformed_line_is_found_verbatim(spark, scorer):
    from innsight.session import scratch_path
    from innsight.streaming.score_stream import REQUEST_SCHEMA, run_score_stream, score_lines
    b = bookings_table(spark, SF_MID)
    year = b.agg(F.min("arrival_year")).first()[0]
    req = as_requests(b).limit(40)
    good = [r[0] for r in req.select(F.to_json(F.struct(*[f.name for f in REQUEST_SCHEMA.fields]))).collect()]
    broken = [good[0][:50], "not json at all", "[1, 2]", '"text"', "{", good[1] + "}", "null", "17",
              good[2].replace('"no_of_adults":', '"no_of_adults":"two", "x":'), "  " + good[3][:-1]]
    lines = spark.createDataFrame([(x,) for x in good + broken + ["", "   "]], "value string")
    ok, bad = score_lines(lines, scorer, year)
    dead = {r["raw"]: r["errors"] for r in bad.collect()}
    for x in broken:
        if x.startswith(good[1]):
            continue            # a complete object with more behind it: the reader takes the object
        want = ["no_of_adults: not of type bigint"] if "two" in x else ["malformed JSON"]
        assert dead[x] == want, x
    batch, _ = split_valid(validate_bookings(req, year))
    src = scratch_path(spark, "lines")
    lines.write.text(src)
    acc, rejected = run_score_stream(spark, src, scorer, scratch_path(spark, "out"), scratch_path(spark, "ckpt"), year)
    assert {r["raw"] for r in rejected.collect()} == set(dead)
    one = flatten_response(scorer.score(batch))
    scored = flatten_response(acc)
    assert scored.dropDuplicates().exceptAll(one).count() == 0 and one.exceptAll(scored).count() == 0


def test_a_stream_takes_up_a_new_release_between_batches(spark, clf, reg):
    import os
    from innsight.operators.scoring import ReleasedScorer
    from innsight.session import scratch_path
    from innsight.sources.tables import current_release, release, save_production, write_run_record
    from innsight.streaming.score_stream import run_score_stream, write_requests
    runs, base = scratch_path(spark, "runs"), scratch_path(spark, "prod")
    names = clf["meta"]["model_name"], reg["meta"]["model_name"]
    with pytest.raises(ValueError, match="nothing is released"):
        ReleasedScorer(spark, base).current()
    for version in ("1.0.0", "2.0.0"):
        for fin, kind in ((clf, "classifier"), (reg, "regressor")):
            path = save_production(fin, scratch_path(spark, kind))
            write_run_record(spark, {**MQ._run_record(fin, path, kind), "version": version}, runs)
    with pytest.raises(ValueError, match="9.9.9"):
        release(spark, base, runs, (names[0], "9.9.9"), (names[1], "1.0.0"))
    assert release(spark, base, runs, (names[0], "1.0.0"), (names[1], "1.0.0")) == 1
    scorer = ReleasedScorer(spark, base)
    first = scorer.current()
    assert scorer.current() is first                     # loaded once
    b = bookings_table(spark, SF_MID)
    year = b.agg(F.min("arrival_year")).first()[0]
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    seen = []
    for version in ("1.0.0", "2.0.0", "1.0.0"):
        if seen:
            release(spark, base, runs, (names[0], version), (names[1], "2.0.0"))
        part = write_requests(as_requests(b).limit(30 + len(seen)).coalesce(1), scratch_path(spark, "part"))
        os.makedirs(src, exist_ok=True)
        for f in os.listdir(part):
            if f.startswith("part-"):
                os.link(f"{part}/{f}", f"{src}/{len(seen)}-{f}")
        acc, _ = run_score_stream(spark, src, scorer, out, ckpt, year)
        got = {r["batch_id"]: r["v"] for r in acc.groupBy("batch_id").agg(
            F.max("model_versions.cancellation").alias("v")).collect()}
        seen.append(version)
        assert [got[i] for i in sorted(got)] == seen     # former batches keep the version that scored them
    assert current_release(spark, base)["sequence"] == 3


def test_calibrator_stage_interpolates_like_the_fitted_map(spark, tmp_path):
    from innsight.operators.calibrated import Calibrator, CalibratorModel, interpolated
    import random
    rng = random.Random(4)
    rows = [(p, int(rng.random() < p * p)) for p in (rng.random() for _ in range(900))]
    df = spark.createDataFrame(rows, "prob double, label int")
    for method, fit in (("isotonic", E.fit_isotonic), ("sigmoid", E.fit_sigmoid)):
        m = Calibrator(inputCol="prob", method=method, threshold=0.4).fit(df)
        test = spark.createDataFrame([(x / 100 - 0.1,) for x in range(121)], "prob double").union(df.select("prob"))
        want = E.apply_calibrator(test, fit(df), method, "prob", "want")
        path = str(tmp_path / method)
        m.write().save(path)
        got = CalibratorModel.load(path).transform(want)
        r = got.agg(F.max(F.abs(F.col("want") - F.col("prob_cal"))),
                    F.sum(((F.col("prob_cal") >= 0.4).cast("int") != F.col("predicted_label")).cast("int"))).first()
        assert r[0] < 1e-12 and r[1] == 0
    assert Calibrator(inputCol="prob").fit(df).getOrDefault("method") in ("isotonic", "sigmoid")
    x = spark.createDataFrame([(None,), (float(-1),), (0.5,), (9.0,)], "x double")
    assert [r[0] for r in x.select(interpolated(F.col("x"), [0.0, 1.0, 2.0], [0.0, 10.0, 10.0])).collect()] == [None, 0, 5, 10]
    assert [r[0] for r in x.select(interpolated(F.col("x"), [0.3], [0.7])).collect()] == [None, 0.7, 0.7, 0.7]
