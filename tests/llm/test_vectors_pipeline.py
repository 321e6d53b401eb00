"""Embedding near-dedup and the pipeline against brute force; the driver contract."""

import importlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from innsight.llm import embeddings, language
from tests.llm.helpers import classes, edge_docs, empty_docs

VEC = "vec_id long, embedding array<float>, label int"


def _brute(rows, threshold=0.98):
    sound, unit = [], {}
    for k, (_, e, label) in enumerate(rows):
        if label is None or e is None or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = np.array(e, dtype=np.float32).astype(np.float64)
        if np.abs(v).max() > 0:
            unit[k] = v / np.sqrt((v * v).sum())
            sound.append(k)
    links = [(a, b) for a in sound for b in sound if b < a and rows[a][2] == rows[b][2]
             and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    n = np.bincount([x for p in links for x in p], minlength=len(rows))
    root = classes(len(rows), links)
    low = {}
    for k, c in enumerate(root):
        if rows[k][0] is not None:
            low[c] = min(low.get(c, rows[k][0]), rows[k][0])
    return sorted((str(rows[k][0]), int(n[k]), str(low.get(c))) for k, c in enumerate(root))


def _check(spark, rows, **kw):
    df = spark.createDataFrame(rows, VEC).withColumn("cell", F.lit("clash"))
    got = embeddings.embedding_groups(df, **kw).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == _brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embedding_groups_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centre[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2, 1.0])
        rows.append((i * 3, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(40)]
    for kw in ({}, {"cell_vectors": 10}, {"cell_vectors": 40, "block": 16},
               {"cell_vectors": 8, "max_cells": 3, "max_inner": 6}):      # cells within cells
        _check(spark, rows, **kw)


def test_embedding_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0),
            (8, [1.0, None, 3.0], 0), (9, [float("nan"), 1.0, 1.0], 0), (10, [float("inf"), 1.0, 1.0], 0),
            (11, [1.0, 2.0], 0), (12, v, 0), (12, v, 0), (None, [-1.0, 5.0, 0.0], 2), (13, [1e-30, 2e-30, 3e-30], 0)]
    _check(spark, rows)
    assert embeddings.embedding_groups(spark.createDataFrame([], VEC)).count() == 0


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    line = "a line that many documents hold"
    plant = [(900000 + i, f"{line}\nown text of number {i} nobody else has {'x' * i}", "en", "s", 1) for i in range(12)]
    plant += [(910000, "12 34 !!", "en", "s", 1), (910001, None, "en", "s", 1),
              (910002, f"before it {item} after it", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(plant, docs.schema))
    columns, n = docs.columns, docs.count()
    names, out = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
        out.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/t-{name}-{id(out)}")
        before, out = out, spark.read.parquet(path)
        names.append(name)
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "byte_bpe":
            assert out.columns == columns
        if name == "language_id":
            assert out.count() == n - 2 and not {910000, 910001} & ids
        if name == "line_dedup":
            assert out.filter(F.col("text").contains(line)).count() == 0 and out.count() == n - 2
            assert out.filter("n_chars != length(text)").count() == 0
        if name == "near_dup":
            text = {r["doc_id"]: r["text"] for r in out.collect()}
            full = [t for t in text.values() if t.strip()]
            assert len(set(full)) == len(full)
        if name == "decontaminate":
            assert 910002 not in ids and {900000 + i for i in range(12)} <= ids
    assert len(names) == 5 and before is not None
    assert out.filter("n_tokens IS NULL").count() == 0


def test_pipeline_on_edge_documents(spark):
    out = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, out, "/root/testdata/sf0.001")
        assert out.columns == edge_docs(spark).columns
    assert out.count() > 0
    empty = empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
    assert language.UND == "und"


def test_registered_queries():
    names = [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
    assert sorted(int(q[2:].split("_")[0]) for q in names if q != "pipeline") == list(range(1, 14))
    assert "pipeline" in names
    assert importlib.util.find_spec("innsight.llm") is not None
