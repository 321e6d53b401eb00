"""Sharding by sampled splitters.

Size-weighted key samples give quantile boundaries, records are range-
partitioned by them, ranges that turn out overfull are subdivided, and exact
running sizes over the ranges cut the whole order into shards. The sample only
decides how the work is dealt out: the cuts themselves are exact, so shard
sizes differ by at most one record.

Defined results
* The size of a record is the UTF-8 length of its text plus 1; null text has none.
* Order: range, subdivision, doc_id (nulls first), checksum, size. Equal rows
  (id, checksum and size) are interchangeable. The result depends on the rows
  alone, not on files, partitions or their order.
* A key that alone overfills a range (one id in a third of all rows) is dealt
  over subdivisions by the hash of its records; rows that are equal are counted
  and dealt in pieces, so no task holds all of a hot key.
* A record may be larger than a shard: it lies in the shard of its middle byte.
* An empty table gives an empty result. Input columns other than doc_id and
  text do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.columns import written


PIECE_ROWS = 1 << 16


def split_points(keys: list[int], n_ranges: int) -> np.ndarray:
    """Quantile boundaries of a (size-weighted) key sample: distinct, ascending."""
    ordered = np.sort(np.asarray(keys, dtype=np.int64))
    if not len(ordered):
        return ordered
    at = (np.arange(1, n_ranges) * len(ordered)) // n_ranges
    return np.unique(ordered[at])


def _range_of(points: np.ndarray):
    @F.pandas_udf("int")
    def f(key: pd.Series) -> pd.Series:
        known = key.notna()
        at = np.searchsorted(points, key.where(known, 0).to_numpy(dtype=np.int64), side="right") + 1
        return pd.Series(np.where(known, at, 0).astype(np.int32))
    return f


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, doc_id: str = "doc_id", text: str = "text",
                   range_bytes: int = 64 << 20, min_ranges: int = 256, max_ranges: int = 65536,
                   sample_per_range: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: byte-balanced shards 0 .. n_shards - 1.

    The number of ranges follows the input (``range_bytes`` of text each,
    within the two bounds); the key sample holds about ``sample_per_range``
    keys a range and is the only data that reaches the driver besides totals.
    """
    recs = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    # the three numbers and how many rows have them; the texts are read once
    recs = written(recs.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "shard-records")
    total = recs.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    n_ranges = int(min(max_ranges, max(min_ranges, total // range_bytes)))
    rate = n_ranges * sample_per_range / max(total, 1)
    # a record is drawn with a chance in proportion to its size, by its own hash
    u = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = [r[0] for r in recs.filter(F.col("doc_id").isNotNull() & (
        u < F.least(F.lit(1.0), F.col("size") * F.col("n") * rate))).select("doc_id").collect()]
    ranged = recs.withColumn("range", _range_of(split_points(sample, n_ranges))("doc_id"))

    # overfull ranges are subdivided
    full = 2 * max(1, total // n_ranges)
    sizes = ranged.groupBy("range").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    subs = sizes.select("range", F.greatest(
        F.ceil(F.col("bytes") / full), F.ceil(F.col("rows") / F.lit(1 << 20))).cast("int").alias("subs"))
    # equal rows in pieces of bounded size; a piece goes where its hash says
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE_ROWS}")))
    ranged = ranged.join(F.broadcast(subs), "range").withColumn("piece", piece).withColumn(
        "n", F.least(F.lit(PIECE_ROWS), F.col("n") - F.col("piece") * PIECE_ROWS)).withColumn(
        "sub", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "piece"), F.col("subs")).cast("int"))
    ranged = written(ranged.drop("subs"), "shard-ranges")

    # one row per subdivision: bounded by 3 x max_ranges, however large the input
    order = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range", "sub").agg(
        F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("r")).select(
        "range", "sub", F.coalesce(F.sum("b").over(order), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("r").over(order), F.lit(0)).alias("row0"))
    w = Window.partitionBy("range", "sub").orderBy(
        F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "piece")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(starts), ["range", "sub"]).select(
        "doc_id", "size", "text_crc32", "n",
        (F.col("byte0") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0))).alias("byte0"),
        (F.col("row0") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("row0"))
    placed = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "doc_id", "size", "text_crc32", (F.col("byte0") + F.col("i") * F.col("size")).alias("byte"),
        (F.col("row0") + F.col("i")).alias("row"))
    middle = F.expr(f"((2 * byte + size) * {n_shards}) div {2 * max(total, 1)}")
    placed = written(placed.withColumn("shard", F.least(
        F.lit(n_shards - 1), middle).cast("int")), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("row0"))   # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("row0")).alias("slot"))
