"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one
representative per group.

Equal vectors of a label are collapsed first. Spherical k-means, fitted on a
bounded sample of distinct vectors (``sample``, by order of their hash), gives
the cells, numbered. A vector lives in the cell of its nearest centroid, and a
copy of it visits every later cell that could hold a vector within reach: for
a home centroid a and another b that is where x.(a - b) <= d |a - b|, d the
largest distance of two linked unit vectors. So every linked pair meets exactly
once, at home or as visitor and resident, whatever the cells are (nothing is
approximate but the layout). Cells over ``block`` vectors are compared as pairs
of blocks, each a task.

Defined results
* A vector that is null, empty or zero, or holds null or non-finite numbers,
  or whose label is null, links with nothing and is its own component.
* Vectors of different lengths don't link. Cosine is computed in doubles.
* Rows that share a vec_id are vectors of their own, in one component if linked.
* A null vec_id gives a null component_id unless linked to a row with an id.
* Empty tables give empty results. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.columns import written
from innsight.llm.components import connected_components


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest number first avoids overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-300), c)
    return np.unique(c, axis=0)


def _near_planes(sim: np.ndarray, home: np.ndarray, gap: np.ndarray, reach: float) -> np.ndarray:
    """Cells whose bisecting plane with the vector's own cell is within reach; the own one is always."""
    own = sim[np.arange(len(sim)), home]
    return own[:, None] - sim <= reach * gap[home]


def _gaps(c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) if len(c) else c


def _visits(x: np.ndarray, c: np.ndarray, inner: list[np.ndarray], reach: float):
    """(vector, cell, is it at home there) for unit vectors, cells numbered outer * width + inner."""
    width = max([1] + [len(i) for i in inner])
    sim = x @ c.T
    home = sim.argmax(axis=1)
    go = _near_planes(sim, home, _gaps(c), reach) & (np.arange(len(c)) > home[:, None])
    go[np.arange(len(x)), home] = True
    vector, outer = np.nonzero(go)
    rows, cells, at_home = [], [], []
    for o in np.unique(outer):
        mine = vector[outer == o]
        resident = home[mine] == o
        if len(inner[o]) < 2:
            rows.append(mine)
            cells.append(np.full(len(mine), o * width))
            at_home.append(resident)
            continue
        inside = x[mine] @ inner[o].T
        near = inside.argmax(axis=1)
        # residents go on to later inner cells, visitors to all within reach
        step = _near_planes(inside, near, _gaps(inner[o]), reach)
        step &= (np.arange(len(inner[o])) >= near[:, None]) | ~resident[:, None]
        step[np.arange(len(mine)), near] = True
        i, b = np.nonzero(step)
        rows.append(mine[i])
        cells.append(o * width + b)
        at_home.append(resident[i] & (near[i] == b))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(at_home)


def _cells(centroids, threshold: float):
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, inner = centroids.value
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("embedding"))
            dims = np.diff(vec.offsets.to_numpy())
            fits = np.flatnonzero(dims == c.shape[1]) if len(c) else np.zeros(0, np.int64)
            odd = np.setdiff1d(np.arange(batch.num_rows), fits)      # other lengths: one cell
            row, cell, home = [odd], [np.full(len(odd), -1)], [np.ones(len(odd), bool)]
            if len(fits):
                x = np.asarray(vec.take(pa.array(fits)).flatten(), dtype=np.float64).reshape(len(fits), -1)
                i, b, h = _visits(unit(x), c, inner, reach)
                row.append(fits[i])
                cell.append(b)
                home.append(h)
            row, cell, home = np.concatenate(row), np.concatenate(cell), np.concatenate(home)
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(cell, pa.int32()), pa.array(home)],
                names=[*out.schema.names, "cell", "home"])
    return run


def _links(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        i, j = group["bi"][0].as_py(), group["bj"][0].as_py()
        x = np.asarray(group["embedding"].combine_chunks().flatten(), dtype=np.float64)
        x = unit(x.reshape(group.num_rows, -1))
        uid, n, home, mine = (group[c].to_numpy() for c in ("uid", "n", "home", "mine"))
        rows, cols = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        near = (x[rows] @ x[cols].T >= threshold) & (home[rows][:, None] | home[cols][None, :])
        if i == j:
            np.fill_diagonal(near, False)
        links = np.zeros(len(uid), dtype=np.int64)
        links[rows] += near @ n[cols]
        if i != j:
            links[cols] += near.T @ n[rows]
        a, b = np.nonzero(near)
        a, b = rows[a], cols[b]
        root = np.arange(len(uid))
        while len(a):                 # smallest place reachable inside the block pair
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        joined = np.flatnonzero(root != np.arange(len(uid)))
        counted = np.flatnonzero(links > 0)
        return pa.table({
            "uid": np.concatenate([uid[counted], uid[joined]]),
            "links": np.concatenate([links[counted], np.zeros(len(joined), np.int64)]),
            "peer": np.concatenate([uid[counted], uid[root[joined]]])})
    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, sample: int = 20000,
                     cell_vectors: int = 8192, max_cells: int = 512, max_inner: int = 16, block: int = 1024,
                     vec_id: str = "vec_id", embedding: str = "embedding",
                     label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                       F.col(embedding).alias("embedding"))
    sound = (F.col("label").isNotNull() & F.col("embedding").isNotNull()
             & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("embedding", lambda x: x != 0))
    rows = v.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(
        "label", F.size("embedding"), "embedding")).alias("uid"))
    uniq = written(v.filter(sound).withColumn("uid", F.xxhash64(
        "label", F.size("embedding"), "embedding")).groupBy("uid").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding")), "vectors")

    n_uniq = uniq.count()
    some = uniq.select("uid", "embedding").orderBy("uid").limit(sample).toPandas()["embedding"]
    dims = some.map(len).mode()
    c, inner = np.zeros((0, 0)), []
    if len(dims):
        x = unit(np.stack(some[some.map(len) == int(dims.max())].to_numpy()).astype(np.float64))
        wanted = max(1, n_uniq // cell_vectors)
        c = spherical_kmeans(x, int(min(max_cells, wanted)))
        more = int(min(max_inner, -(-wanted // max_cells)))
        near = (x @ c.T).argmax(axis=1)
        inner = [spherical_kmeans(x[near == o], more) if more > 1 and (near == o).any() else c[o:o + 1]
                 for o in range(len(c))]
    centroids = spark.sparkContext.broadcast((c, inner))      # at most max_cells * max_inner vectors

    schema = uniq.drop("rep").schema.add("cell", "integer").add("home", "boolean")
    placed = uniq.drop("rep").mapInArrow(_cells(centroids, threshold), schema).withColumn(
        "dims", F.size("embedding"))
    cell = ["label", "dims", "cell"]
    sizes = placed.drop("embedding").groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = placed.join(sizes, cell).withColumn(
        "mine", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "bi", F.least("o", "mine")).withColumn("bj", F.greatest("o", "mine"))
    found = written(placed.groupBy(*cell, "bi", "bj").applyInArrow(
        _links(threshold), "uid long, links long, peer long"), "vector-links")

    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("uid != peer").select(
        F.col("uid").alias("a"), F.col("peer").alias("b")))
    named = uniq.select("uid", "rep", "n").join(comps.withColumnRenamed("id", "uid"), "uid", "left").join(
        links, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_vector = named.join(lowest, "component").select(
        "uid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    return rows.join(per_vector, "uid", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & F.col("component_id").isNull()))
