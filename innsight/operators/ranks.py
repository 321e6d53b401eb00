"""Global ranks and prefix sums without a single-partition window.

An ``orderBy`` window with no ``partitionBy`` moves every row into one task.
Instead the rows (usually already collapsed to one row per distinct value)
are range-partitioned on the order key, summed inside each partition, and
the per-partition totals (one row per partition, a proven small bound) are
turned into offsets and broadcast back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.functions.columns import scalar
from innsight.session import ensure_checkpoint_dir


def bounded_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound; beyond it a join shuffles."""
    return F.broadcast(df) if df.count() <= max_rows else df


def _range_partition(df: DataFrame, cols: list[str], num_partitions: int | None) -> DataFrame:
    """Range-partition on ``cols`` and sort inside each partition. Without an
    explicit count the shuffle uses the session's partition count and AQE may
    coalesce neighbouring (still ordered) partitions to a sensible size."""
    ranged = (df.repartitionByRange(num_partitions, *cols) if num_partitions
              else df.repartitionByRange(*cols))
    return ranged.sortWithinPartitions(*cols)


def _running(x, carry):
    """(exclusive running sums, total) of one Arrow column, nulls as 0, in its own type."""
    import numpy as np
    import pyarrow as pa
    v = x.fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(v, dtype=v.dtype)
    return pa.array(total - v + carry, type=x.type), (total[-1] if len(v) else 0)


def _local_sums(order_cols: list[str], value_cols: list[str]):
    """Per-partition exclusive running sums (partition rows arrive sorted).
    Only the value columns are touched; all others pass through as they are."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry = {v: 0 for v in value_cols}
        for b in batches:
            cols, names = list(b.columns), list(b.schema.names)
            for v in value_cols:
                local, total = _running(b.column(names.index(v)), carry[v])
                carry[v] = carry[v] + total
                cols.append(local)
            cols.append(pa.array([pid] * b.num_rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                cols, names=names + [f"_{v}_local" for v in value_cols] + ["_pid"])
    return run


def prefix_sums(df: DataFrame, order_cols: list[str], value_cols: list[str],
                num_partitions: int | None = None) -> DataFrame:
    """Add ``<v>_before`` = sum of ``v`` over all rows strictly earlier in the
    global order of ``order_cols`` (which must be unique per row).

    One shuffle: rows are range-partitioned on the order and sorted inside
    each partition; running sums inside a partition are computed on its Arrow
    batches (vectorised, no second shuffle); the result is materialised with
    a reliable checkpoint so that the per-partition totals are taken from
    exactly the same partitions (range bounds come from sampling); the
    totals, one row per partition, become broadcast offsets."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = _range_partition(df, order_cols, num_partitions)
    fields = list(ranged.schema.fields)
    types = {f.name: f.dataType for f in fields}
    out_schema = T.StructType(fields + [T.StructField(f"_{v}_local", types[v]) for v in value_cols]
                              + [T.StructField("_pid", T.IntegerType())])
    local = ranged.mapInArrow(_local_sums(order_cols, value_cols), out_schema).checkpoint(eager=True)
    totals = local.groupBy("_pid").agg(*[F.sum(v).alias(f"_{v}_tot") for v in value_cols])
    # one row per partition: the window below sees only that many rows
    w_off = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *[F.coalesce(F.sum(f"_{v}_tot").over(w_off), F.lit(0)).alias(f"_{v}_off")
                  for v in value_cols])
    out = local.join(F.broadcast(offsets), "_pid")
    for v in value_cols:
        out = out.withColumn(f"{v}_before", F.col(f"_{v}_local") + F.col(f"_{v}_off"))
    return out.drop("_pid", *[f"_{v}_local" for v in value_cols],
                    *[f"_{v}_off" for v in value_cols])


def _segment_sums(seg_cols: list[str], value_cols: list[str]):
    """Per-partition exclusive running sums that restart at every segment
    (rows arrive sorted by segment, then order). Adds ``_first`` = 1 on rows of
    the partition's first segment (which may have started in an earlier
    partition). Segment boundaries come from comparing each row's key with
    the previous row's (vectorised; null keys are equal to each other). Only
    key and value columns are read; all others pass through as Arrow."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last_key = None
        in_first = True  # every row so far belongs to the partition's first segment
        carry = {v: 0 for v in value_cols}
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            names = list(b.schema.names)
            change = np.zeros(n, dtype=bool)
            change[0] = True
            for c in seg_cols:
                x = b.column(names.index(c))
                a, z = x.slice(0, n - 1), x.slice(1)
                same = pc.fill_null(pc.equal(a, z), False).to_numpy(zero_copy_only=False)
                both_null = pc.and_(pc.is_null(a), pc.is_null(z)).to_numpy(zero_copy_only=False)
                change[1:] |= ~(same | both_null)
            starts = np.flatnonzero(change)
            seg_id = np.cumsum(change) - 1
            key = lambda i: tuple(b.column(names.index(c))[i].as_py() for c in seg_cols)
            continues = last_key is not None and key(0) == last_key
            last_is_first = seg_id[-1] == 0
            cols = list(b.columns)
            for v in value_cols:
                x = b.column(names.index(v))
                val = x.fill_null(0).to_numpy(zero_copy_only=False)
                before = np.cumsum(val, dtype=val.dtype) - val
                local = before - before[starts][seg_id]
                if continues:
                    local = local + np.where(seg_id == 0, carry[v], 0).astype(val.dtype)
                cols.append(pa.array(local, type=x.type))
                tail = val[starts[-1]:].sum()
                carry[v] = (carry[v] if continues and last_is_first else 0) + tail
            first_here = in_first and (last_key is None or continues)
            head = (seg_id == 0) if first_here else np.zeros(n, dtype=bool)
            in_first = first_here and last_is_first
            last_key = key(n - 1)
            cols += [pa.array(head.astype(np.int32)), pa.array(np.full(n, pid, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(
                cols, names=names + [f"_{v}_seg" for v in value_cols] + ["_first", "_pid"])
    return run


def segmented_prefix_sums(df: DataFrame, seg_cols: list[str], order_cols: list[str],
                          value_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Add ``<v>_before`` = sum of ``v`` over the earlier rows of the same
    segment (``seg_cols``), in the order of ``order_cols`` (unique within a
    segment) - a running window per segment, without a window partition.

    Rows are range-partitioned on (segment, order), so a segment holding a
    third of all rows is spread over many partitions. Running sums restart at
    each segment inside a partition (vectorised on Arrow batches); a segment
    that began in earlier partitions gets their totals as a carry, computed
    from a per-partition summary (one row per partition, broadcast). There
    is no join on the segment key, so a hot segment never meets a hot shuffle
    partition."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = seg_cols + order_cols
    ranged = _range_partition(df, keys, num_partitions)
    fields = list(ranged.schema.fields)
    types = {f.name: f.dataType for f in fields}
    out_schema = T.StructType(fields + [T.StructField(f"_{v}_seg", types[v]) for v in value_cols]
                              + [T.StructField("_first", T.IntegerType()),
                                 T.StructField("_pid", T.IntegerType())])
    local = ranged.mapInArrow(_segment_sums(seg_cols, value_cols), out_schema).checkpoint(eager=True)
    # per partition: its first and last segment, the totals of the last
    # segment inside it, and whether it holds a single segment
    seg = F.struct(*seg_cols)
    order = F.struct(*keys)
    summary = local.groupBy("_pid").agg(F.min_by(seg, order).alias("_fs"),
                                        F.max_by(seg, order).alias("_ls"))
    last_tot = (local.join(F.broadcast(summary.select("_pid", "_ls")), "_pid")
                .where(F.struct(*seg_cols) == F.col("_ls"))
                .groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols]))
    rows = (summary.join(last_tot, "_pid", "left").orderBy("_pid").collect())  # n rows
    # One pass over the partitions in order. A partition's carry is the total
    # of its first segment in earlier partitions: the running total of the
    # previous partition's last segment when that segment goes on here. That
    # running total is the partition's own last-segment sum, plus its carry
    # when the partition holds that one segment only.
    carries = []
    prev = None
    end_tot = {v: 0 for v in value_cols}
    for r in rows:
        goes_on = prev is not None and prev["_ls"] == r["_fs"]
        c = {v: end_tot[v] if goes_on else 0 for v in value_cols}
        single = r["_fs"] == r["_ls"]
        end_tot = {v: (r[f"_t_{v}"] or 0) + (c[v] if single else 0) for v in value_cols}
        carries.append((r["_pid"], *[c[v] for v in value_cols]))
        prev = r
    carry_schema = T.StructType([T.StructField("_pid", T.IntegerType())] +
                                [T.StructField(f"_c_{v}", T.LongType() if isinstance(
                                    types[v], (T.IntegerType, T.LongType, T.ShortType))
                                    else T.DoubleType()) for v in value_cols])
    carry_df = spark.createDataFrame(carries, carry_schema)
    out = local.join(F.broadcast(carry_df), "_pid", "left")
    for v in value_cols:
        add = F.when(F.col("_first") == 1, F.coalesce(F.col(f"_c_{v}"), F.lit(0))).otherwise(0)
        out = out.withColumn(f"{v}_before", F.col(f"_{v}_seg") + add)
    return out.drop("_pid", "_first", *[f"_{v}_seg" for v in value_cols],
                    *[f"_c_{v}" for v in value_cols])


def value_ranks(df: DataFrame, col: str, group_cols: list[str] | tuple = (),
                extra_counts: dict | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """One row per (group, distinct non-null value of ``col``) with its count
    ``n``, the number of rows before it inside its group (``n_before``) and
    the average 1-based rank of its ties (``avg_rank``), as pandas
    ``rank(method='average')`` gives.

    ``extra_counts`` maps output names to boolean columns counted per value
    (for example the rows of one sample, for rank-sum tests). Rows are first
    collapsed to distinct values, so heavy ties make this cheaper, not hotter.
    """
    group_cols = list(group_cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, cond in (extra_counts or {}).items():
        aggs.append(F.sum(F.when(cond, 1).otherwise(0)).alias(name))
    known = F.col(col).isNotNull()
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        known = known & ~F.isnan(col)       # NaN is a missing value, as in pandas
    counts = df.where(known).groupBy(*group_cols, col).agg(*aggs)
    if group_cols:
        out = segmented_prefix_sums(counts, group_cols, [col], ["n"], num_partitions)
    else:
        out = prefix_sums(counts, [col], ["n"], num_partitions)
    return out.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0)


def _global_quantiles(vr: DataFrame, col: str, probs: list[float], n) -> DataFrame:
    """Quantiles of the whole column: the two positions around each target
    depend only on the row count ``n`` (a scalar subquery), so the values at
    those positions are conditional maxima in one aggregate over the
    distinct-value table - no join. No rows when the column is empty."""
    def at(pos):
        inside = (pos >= F.col("n_before")) & (pos < F.col("n_before") + F.col("n"))
        return F.max(F.when(inside, F.col(col).cast("double")))

    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (n - 1)
        lo = F.floor(h).cast("long")
        aggs += [at(lo).alias(f"_lo{i}"), at(F.least(lo + 1, n - 1)).alias(f"_hi{i}")]
    wide = vr.agg(*aggs)
    rows = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (n - 1)
        frac = h - F.floor(h)
        v_lo, v_hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        rows.append(F.struct(F.lit(float(p)).alias("prob"),
                             (v_lo + frac * (v_hi - v_lo)).alias("value")))
    return (wide.select(F.explode(F.array(*rows)).alias("_q")).select("_q.prob", "_q.value")
            .where(F.col("value").isNotNull()))


def exact_quantiles(df: DataFrame, col: str, probs: list[float],
                    group_cols: list[str] | tuple = (),
                    num_partitions: int | None = None,
                    max_broadcast_rows: int = 1_000_000,
                    ranks: DataFrame | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (the pandas / numpy default)
    per group, computed without gathering a column or a group into one task.

    Returns one row per (group, probability): (*group_cols, prob, value).
    The target rows (2 per group and probability) are broadcast when the
    counted number of groups keeps them within ``max_broadcast_rows``;
    otherwise they meet the value table in shuffle joins on the group key.
    ``ranks`` is ``value_ranks(df, col, group_cols)`` where the caller has it.
    """
    group_cols = list(group_cols)
    vr = ranks if ranks is not None else value_ranks(df, col, group_cols, num_partitions=num_partitions)
    sizes = vr.groupBy(*group_cols).agg(F.sum("n").alias("_n"))
    if not group_cols:
        return _global_quantiles(vr, col, probs, scalar(sizes, "_n"))
    # one row per group; counted over the checkpointed distinct-value table
    n_groups = sizes.count() if group_cols else 1
    small = n_groups * len(probs) * 2 <= max_broadcast_rows
    bc = F.broadcast if small else (lambda d: d)
    targets = (sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
               .withColumn("_h", F.col("prob") * (F.col("_n") - 1))
               .withColumn("_lo", F.floor("_h").cast("long"))
               .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
               .withColumn("_frac", F.col("_h") - F.floor("_h")))
    pos = (targets.select(*group_cols, F.col("_lo").alias("_pos"))
           .union(targets.select(*group_cols, F.col("_hi").alias("_pos"))).distinct())
    cond = [(F.col("_pos") >= F.col("n_before")) & (F.col("_pos") < F.col("n_before") + F.col("n"))]
    p = pos.alias("p")
    v = vr.alias("v")
    join_cond = cond + [F.col(f"p.{g}") == F.col(f"v.{g}") for g in group_cols]
    stats = (bc(p).join(v, join_cond)
             .select(*[F.col(f"p.{g}").alias(g) for g in group_cols], "_pos",
                     F.col(f"v.{col}").cast("double").alias("_value")))
    lo = stats.withColumnRenamed("_pos", "_lo").withColumnRenamed("_value", "_v_lo")
    hi = stats.withColumnRenamed("_pos", "_hi").withColumnRenamed("_value", "_v_hi")
    res = (targets.join(bc(lo), group_cols + ["_lo"])
           .join(bc(hi), group_cols + ["_hi"]))
    return res.select(*group_cols, "prob",
                      (F.col("_v_lo") + F.col("_frac") * (F.col("_v_hi") - F.col("_v_lo")))
                      .alias("value"))


BRACKET_ACCURACY = 10_000


def bracketed_quantiles(df: DataFrame, series: dict[str, Column], probs: list[float],
                        accuracy: int = BRACKET_ACCURACY) -> DataFrame:
    """Exact quantiles (linear interpolation) of several series of a table: (series, prob, value).

    ``series`` maps names to columns; null and NaN don't count, and a series without values has
    no rows. Three readings, no shuffle of the values: Spark's mergeable quantile summary
    (rank error n / accuracy) puts a bracket around every target; one aggregate counts what
    lies below each bracket; only the values inside a bracket, some 4 n / accuracy rows
    collapsed to distinct values, are sorted. ``exact_quantiles`` sorts all distinct values."""
    spark = df.sparkSession
    names = list(series)
    x = [f"s{i}" for i in range(len(names))]
    wide = df.select(*[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(s)
                       for s, c in zip(x, series.values())])
    margin = 2.0 / accuracy
    low = [min(1.0, max(0.0, p - margin)) for p in probs]
    high = [min(1.0, max(0.0, p + margin)) for p in probs]
    first = wide.agg(*[a for s in x for a in (
        F.count(s).alias(f"n_{s}"), F.percentile_approx(s, low + high, accuracy).alias(f"q_{s}"))]).first()
    found = [(i, j, first[f"q_s{i}"][j], first[f"q_s{i}"][len(probs) + j])
             for i in range(len(names)) if first[f"n_s{i}"] for j in range(len(probs))]
    schema = "key int, series string, prob double, at0 long, at1 long, inside long, frac double, prev double, next double"
    if not found:
        return spark.createDataFrame([], schema).select("series", "prob", F.col("frac").alias("value"))
    aggs = []
    for k, (i, _, lo, hi) in enumerate(found):
        v = F.col(f"s{i}")
        aggs += [F.count(F.when(v < lo, 1)).alias(f"b{k}"), F.max(F.when(v < lo, v)).alias(f"p{k}"),
                 F.count(F.when(v.between(lo, hi), 1)).alias(f"i{k}"), F.min(F.when(v > hi, v)).alias(f"x{k}")]
    second = wide.agg(*aggs).first()
    targets = []
    for k, (i, j, _, _) in enumerate(found):
        n = first[f"n_s{i}"]
        h = probs[j] * (n - 1)
        at = math.floor(h)
        below, inside = second[f"b{k}"], second[f"i{k}"]
        ends = (at - below, min(at + 1, n - 1) - below)      # places within the bracket
        if ends[0] < -1 or ends[1] > inside:
            raise RuntimeError("a quantile lies outside its bracket")
        targets.append((k, names[i], float(probs[j]), *ends, inside, h - at, second[f"p{k}"], second[f"x{k}"]))
    in_bracket = [F.when(F.col(f"s{i}").between(lo, hi), F.struct(F.lit(k).alias("key"), F.col(f"s{i}").alias("v")))
                  for k, (i, _, lo, hi) in enumerate(found)]
    inside = (wide.select(F.explode(F.array_compact(F.array(*in_bracket))).alias("_x")).select("_x.*")
              .groupBy("key", "v").agg(F.count(F.lit(1)).alias("n")))
    ranked = segmented_prefix_sums(inside, ["key"], ["v"], ["n"])
    t = F.broadcast(spark.createDataFrame(targets, schema))       # series x probabilities

    def here(pos: str) -> Column:
        hit = (F.col(pos) >= F.col("n_before")) & (F.col(pos) < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col("v")))
    keys = [f.split()[0] for f in schema.split(", ")]
    out = ranked.join(t, "key").groupBy(*keys).agg(here("at0").alias("v0"), here("at1").alias("v1"))
    v0 = F.when(F.col("at0") < 0, F.col("prev")).otherwise(F.col("v0"))
    v1 = F.when(F.col("at1") < 0, F.col("prev")).when(F.col("at1") >= F.col("inside"), F.col("next")).otherwise(F.col("v1"))
    return out.select("series", "prob", (v0 + F.col("frac") * (v1 - v0)).alias("value"))


def grouped_series(df: DataFrame, col: str, group: str, max_groups: int = 100) -> dict[str, Column] | None:
    """A series for each value of a small domain (None beyond ``max_groups`` values): column ``col`` of its rows."""
    found = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(max_groups + 1).collect()]
    if len(found) > max_groups:
        return None
    return {str(g): F.when(F.col(group) == F.lit(g), F.col(col)) for g in sorted(found, key=str)}
