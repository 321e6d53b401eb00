"""Reproducible train / validation / test splits and class weights.

Rows are ordered by a keyed hash ``md5('<seed>:' || id)`` (then id). A split
is "the first k rows of a stratum in hash order", so membership only needs
the k-th smallest key per stratum. That key is found from bucket counts of
the hash prefix (an aggregate), refined inside the single boundary bucket,
and the split itself is then a pure projection: no sort and no shuffle of
the rows, the same assignment on every run and every cluster size.

Sizes follow the stratified shuffle-split rules: test = ceil(0.2 n), then
validation = ceil(0.25 of the rest); per-class counts by the largest
remainder rule (ties go to the smaller label instead of a random pick).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions.columns import scalars
from innsight.schema import SEED


def hash_key(id_col: str = "Booking_ID", seed: int = SEED) -> Column:
    """Sortable text key: 32 hex digits of the keyed md5, '|', then the id."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return F.concat(h, F.lit("|"), F.col(id_col).cast("string"))


def approximate_mode(class_counts: list[tuple[object, int]], n_draws: int) -> dict:
    """Split ``n_draws`` over classes in proportion to their counts: floors
    first, then one more to the largest remainders (ties: label order)."""
    total = sum(c for _, c in class_counts)
    cont = [(k, c / total * n_draws) for k, c in class_counts]
    out = {k: math.floor(v) for k, v in cont}
    need = n_draws - sum(out.values())
    order = sorted(cont, key=lambda kv: (-(kv[1] - math.floor(kv[1])), str(kv[0])))
    for k, _ in order[:max(need, 0)]:
        out[k] += 1
    return out


def split_allocation(class_counts: list[tuple[object, int]], test_size: float = 0.2,
                     val_size: float = 0.25) -> dict:
    """Per-class (n_test, n_val) for the two-stage stratified split."""
    n = sum(c for _, c in class_counts)
    n_test = math.ceil(test_size * n)
    train1 = approximate_mode(class_counts, n - n_test)
    tv = [(k, train1[k]) for k, _ in class_counts]
    n_tv = sum(c for _, c in tv)
    n_val = math.ceil(val_size * n_tv)
    train2 = approximate_mode(tv, n_tv - n_val)
    return {k: (c - train1[k], train1[k] - train2[k]) for k, c in class_counts}


def _kth_keys(df: DataFrame, strata: str | None, targets: dict, max_exact_rows: int) -> dict:
    """The k-th smallest key (1-based) per stratum for every k in targets[s].

    Works level by level on 4 more hex digits of the hash until the boundary
    bucket is small, then ranks the rows of that bucket only."""
    s_col = F.col(strata) if strata else F.lit(0)
    base = df.select(s_col.alias("_s"), F.col("_key"))
    result = {}
    # pending: (stratum, prefix, k within that prefix)
    pending = [(s, "", k) for s, ks in targets.items() for k in ks if k > 0]
    depth = 0
    while pending:
        depth += 4
        prefixes = {(s, p) for s, p, _ in pending}
        cond = F.lit(False)
        for s, p in prefixes:
            cond = cond | ((F.col("_s") == F.lit(s)) & F.col("_key").startswith(p))
        sub = base.where(cond).withColumn("_b", F.substring("_key", 1, depth))
        counts = {(r["_s"], r["_b"]): r["n"] for r in
                  sub.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("n")).collect()}
        nxt = []
        exact = []
        for s, p, k in pending:
            buckets = sorted(b for (ss, b) in counts if ss == s and b.startswith(p))
            before = 0
            for b in buckets:
                c = counts[(s, b)]
                if before + c >= k:
                    if c <= max_exact_rows or depth >= 32:
                        exact.append((s, b, k - before, k))
                    else:
                        nxt.append((s, b, k - before))
                    break
                before += c
        if exact:
            cond = F.lit(False)
            for s, b, _, _ in exact:
                cond = cond | ((F.col("_s") == F.lit(s)) & F.col("_key").startswith(b))
            ranked = (base.where(cond).withColumn("_b", F.substring("_key", 1, depth))
                      .selectExpr("_s", "_b", "_key",
                                  "row_number() OVER (PARTITION BY _s, _b ORDER BY _key) AS _rn"))
            want = F.lit(False)
            for s, b, r, _ in exact:
                want = want | ((F.col("_s") == F.lit(s)) & (F.col("_b") == b) & (F.col("_rn") == r))
            got = {(row["_s"], row["_b"], row["_rn"]): row["_key"]
                   for row in ranked.where(want).collect()}
            for s, b, r, k in exact:
                result[(s, k)] = got[(s, b, r)]
        pending = nxt
    return result


def assign_split(df: DataFrame, id_col: str = "Booking_ID", strata: str | None = "label",
                 seed: int = SEED, test_size: float = 0.2, val_size: float = 0.25,
                 max_exact_rows: int = 2_000_000) -> DataFrame:
    """Add ``split`` in {'train', 'val', 'test'} with exact stratified sizes.

    Driver work is bounded: class counts (one row per stratum), bucket
    counts of the hash prefix (at most 65,536 per stratum and level) and the
    few cut-off keys."""
    keyed = df.withColumn("_key", hash_key(id_col, seed))
    s_col = F.col(strata) if strata else F.lit(0)
    class_counts = [(r["_s"], r["n"]) for r in
                    keyed.groupBy(s_col.alias("_s")).agg(F.count(F.lit(1)).alias("n"))
                    .orderBy("_s").collect()]
    alloc = split_allocation(class_counts, test_size, val_size)
    targets = {s: (t, t + v) for s, (t, v) in alloc.items()}
    cuts = _kth_keys(keyed, strata, targets, max_exact_rows)
    expr = F.lit("train")
    for s, (t, tv) in targets.items():
        in_s = (s_col == F.lit(s)) if strata else F.lit(True)
        if tv > t:
            expr = F.when(in_s & (F.col("_key") <= F.lit(cuts[(s, tv)])), F.lit("val")).otherwise(expr)
        if t > 0:
            expr = F.when(in_s & (F.col("_key") <= F.lit(cuts[(s, t)])), F.lit("test")).otherwise(expr)
    return keyed.withColumn("split", expr).drop("_key")


UNIT = 2 ** 32


def hash_split(df: DataFrame, id_col: str = "Booking_ID", seed: int = SEED, test_size: float = 0.2,
               val_size: float = 0.2) -> DataFrame:
    """Add ``split`` by the row's own hash: the scale mode of the split.

    The first 32 bits of the keyed md5 fall below test_size (test), below
    test_size + val_size (val), or above (train). No count, no sort and no shuffle,
    and a table that grows never moves an old row. Every stratum is a fair sample,
    so its shares hold within binomial bounds, not exactly. A null id is train."""
    if not (0 <= test_size and 0 <= val_size and test_size + val_size <= 1):
        raise ValueError("shares lie between 0 and 1 and add up to 1 at most")
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long")
    t = math.floor(test_size * UNIT)
    v = math.floor((test_size + val_size) * UNIT)
    return df.withColumn("split", F.when(place < t, "test").when(place < v, "val").otherwise("train"))


def split_sizes(split_df: DataFrame, label: str = "label") -> DataFrame:
    """(split, n_rows, n_canceled, pct_canceled)."""
    return (split_df.groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.col(label)).cast("bigint").alias("n_canceled"),
                 (F.avg(F.col(label).cast("double")) * 100.0).alias("pct_canceled")))


def class_weights(split_df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (2 n_c) and the integer negative:positive ratio,
    from the training rows only."""
    train = split_df.where(F.col("split") == "train")
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = train.agg(F.count(F.lit(1)).alias("_n"),
                    F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("_neg"),
                    F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"))
    return (counts.withColumns(scalars(tot))
            .select(label, "n",
                    (F.col("_n") / (2.0 * F.col("n"))).alias("weight"),
                    F.floor(F.try_divide(F.col("_neg").cast("double"), F.col("_pos")))
                    .cast("bigint").alias("scale_pos_weight")))


def with_class_weight(split_df: DataFrame, label: str = "label",
                      weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (the 2-row weight table
    is broadcast; its size is fixed by the number of classes)."""
    w = class_weights(split_df, label).select(label, F.col("weight").alias(weight_col))
    return split_df.join(F.broadcast(w), label, "left")
