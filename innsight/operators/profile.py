"""Descriptive profiles of the bookings table.

Each operator is one declarative plan: a grouped aggregate (map-side partial
plus final hash aggregate), a pivot, or a rank computation over distinct
values. Small result tables are never pulled to the driver.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.functions.columns import arrival_as_date, is_canceled, month_abbr, pct, scalars
from innsight.operators.ranks import (bounded_broadcast, bracketed_quantiles, exact_quantiles,
                                      grouped_series, value_ranks)
from innsight.schema import (BOOKING_STATUSES, PROFILE_CATEGORICAL, PROFILE_NUMERIC,
                             SPEARMAN_COLUMNS)


def _rate() -> Column:
    return (F.avg(is_canceled()) * 100.0).alias("cancel_rate_pct")


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


# ---------------------------------------------------------------------------
# target
# ---------------------------------------------------------------------------

def target_distribution(df: DataFrame) -> DataFrame:
    """Rows and share per status; rows without a status are left out of both."""
    counts = (df.where(F.col("booking_status").isNotNull())
              .groupBy("booking_status").agg(F.count(F.lit(1)).alias("count")))
    total = F.sum("count").over(Window.partitionBy())  # over the 2-row result only
    return counts.withColumn("pct", pct(F.col("count"), total))


def imbalance_ratio(df: DataFrame) -> DataFrame:
    c = is_canceled()
    agg = df.agg(F.sum(1 - c).cast("bigint").alias("n_not_canceled"),
                 F.sum(c).cast("bigint").alias("n_canceled"))
    return agg.withColumn("ratio", F.try_divide(F.col("n_not_canceled").cast("double"),
                                                F.col("n_canceled")))


# ---------------------------------------------------------------------------
# numeric and categorical summaries
# ---------------------------------------------------------------------------

def _stack_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    items = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {items}) AS (column_name, value)")


def numeric_summary(df: DataFrame, cols: list[str] = PROFILE_NUMERIC) -> DataFrame:
    """count, mean, sample std, min, quartiles, max, and the bias-corrected
    skewness (G1) and excess kurtosis (G2) that pandas reports, per column.

    Moments come from one wide aggregate, whose single row is then unpivoted;
    the quartiles are exact (linear interpolation), from brackets around them."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
             "_g1": F.skewness, "_g2": F.kurtosis}
    wide = df.agg(*[fn(F.col(c).cast("double")).alias(f"{s}|{c}")
                    for c in cols for s, fn in stats.items()])
    items = ", ".join(f"'{c}', " + ", ".join(f"`{s}|{c}`" for s in stats) for c in cols)
    moments = wide.selectExpr(f"stack({len(cols)}, {items}) AS (column_name, {', '.join(stats)})")
    q = bracketed_quantiles(df, {c: F.col(c) for c in cols}, [0.25, 0.5, 0.75]).withColumnRenamed(
        "series", "column_name")
    qw = q.groupBy("column_name").pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("value"))
    qw = qw.toDF("column_name", "q25", "q50", "q75")
    n = F.col("count").cast("double")
    g1 = F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)
    return (moments.join(F.broadcast(qw), "column_name")
            .select("column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max",
                    g1.alias("skewness"), g2.alias("kurtosis")))


def categorical_counts(df: DataFrame, cols: list[str] = PROFILE_CATEGORICAL) -> DataFrame:
    """(column_name, value, count, pct) for each categorical column."""
    items = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {items}) AS (column_name, value)")
    counts = (long.where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")))
    total = F.sum("count").over(Window.partitionBy("column_name"))
    return counts.withColumn("pct", pct(F.col("count"), total))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, count) for discrete numeric columns."""
    items = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {items}) AS (column_name, value)")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------------------
# cancellation rates
# ---------------------------------------------------------------------------

def cancel_rate_by(df: DataFrame, group_col: str) -> DataFrame:
    """Canceled share (percent) and row count per value of ``group_col``."""
    return df.groupBy(group_col).agg(_rate(), _n())


def overall_cancel_rate(df: DataFrame) -> DataFrame:
    return df.agg(_rate(), _n())


# fixed values: lead-time bins (left-open, right-closed) and their labels
LEAD_BINS = [0, 14, 30, 60, 90, 180, 365, 500]
LEAD_LABELS = ["0–14", "15–30", "31–60", "61–90", "91–180", "181–365", "365+"]


def lead_bucket(lead: Column) -> Column:
    """Right-closed bins (0,14], (14,30], ... (365,500]; lead 0 and > 500 fall
    outside every bin (NULL), as in the published table."""
    expr = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(LEAD_BINS[:-1], LEAD_BINS[1:], LEAD_LABELS))):
        expr = F.when((lead > lo) & (lead <= hi), F.lit(label)).otherwise(expr)
    return expr


def cancel_rate_by_lead_bucket(df: DataFrame) -> DataFrame:
    b = lead_bucket(F.col("lead_time"))
    order = F.array_position(F.array(*[F.lit(x) for x in LEAD_LABELS]), F.col("lead_bucket"))
    return (df.withColumn("lead_bucket", b).where(F.col("lead_bucket").isNotNull())
            .groupBy("lead_bucket").agg(_rate(), _n())
            .withColumn("bucket_order", order.cast("bigint")))


def monthly_volume(df: DataFrame) -> DataFrame:
    c = is_canceled()
    return (df.groupBy("arrival_year", "arrival_month")
            .agg(F.count(F.lit(1)).alias("total"), F.sum(c).cast("bigint").alias("canceled"))
            .withColumn("cancel_rate", pct(F.col("canceled"), F.col("total"))))


def month_status_pivot(df: DataFrame) -> DataFrame:
    """Bookings per arrival month and status, zero-filled, fixed column order."""
    p = (df.groupBy("arrival_month").pivot("booking_status", BOOKING_STATUSES)
         .agg(F.count(F.lit(1))).fillna(0, subset=BOOKING_STATUSES))
    return p.select("arrival_month", month_abbr().alias("month_label"),
                    *[F.col(s).cast("bigint").alias(s) for s in BOOKING_STATUSES])


def cancel_rate_by_month(df: DataFrame) -> DataFrame:
    return (df.groupBy("arrival_month").agg(_rate(), _n())
            .withColumn("month_label", month_abbr()))


def price_by_month(df: DataFrame) -> DataFrame:
    """Mean and sample std of price > 0 by arrival month, and mean +/- std."""
    g = (df.where(F.col("avg_price_per_room") > 0).groupBy("arrival_month")
         .agg(F.avg("avg_price_per_room").alias("mean_price"),
              F.stddev_samp("avg_price_per_room").alias("std_price")))
    return (g.withColumn("band_lower", F.col("mean_price") - F.col("std_price"))
            .withColumn("band_upper", F.col("mean_price") + F.col("std_price"))
            .withColumn("month_label", month_abbr()))


def monthly_trend_label(df: DataFrame) -> DataFrame:
    """'Jul 17'-style label, volume and cancel rate per (year, month)."""
    label = F.date_format(arrival_as_date(day=F.lit(1)), "MMM yy")   # null for month 0 or 13
    return (df.groupBy("arrival_year", "arrival_month")
            .agg(F.count(F.lit(1)).alias("volume"), _rate())
            .withColumn("label", label))


def cancel_rate_repeat_guest(df: DataFrame) -> DataFrame:
    return (df.groupBy("repeated_guest").agg(_rate(), _n())
            .withColumn("guest_label", F.when(F.col("repeated_guest") == 0, "New Guest")
                        .when(F.col("repeated_guest") == 1, "Repeat Guest")))


def cancel_rate_prior_capped(df: DataFrame, cap: int = 5) -> DataFrame:
    capped = F.least(F.col("no_of_previous_cancellations"), F.lit(cap))
    return (df.withColumn("prev_cancel_capped", capped)
            .groupBy("prev_cancel_capped").agg(_rate(), _n())
            .withColumn("label", F.when(F.col("prev_cancel_capped") == cap, f"{cap}+")
                        .otherwise(F.col("prev_cancel_capped").cast("string"))))


# ---------------------------------------------------------------------------
# dashboard tables
# ---------------------------------------------------------------------------

def dashboard_kpis(df: DataFrame) -> DataFrame:
    c = is_canceled()
    return df.agg(
        F.count(F.lit(1)).alias("total_bookings"),
        (F.avg(c) * 100.0).alias("cancellation_rate"),
        F.avg("avg_price_per_room").alias("avg_room_price"),
        (F.avg(F.col("repeated_guest").cast("double")) * 100.0).alias("repeat_guest_rate"),
        F.sum(c).cast("bigint").alias("total_canceled"),
        F.sum(1 - c).cast("bigint").alias("total_not_canceled"),
    )


def cancel_rate_requests_rollup(df: DataFrame) -> DataFrame:
    r = F.least(F.col("no_of_special_requests"), F.lit(3))
    label = F.when(r >= 3, F.lit("3+")).otherwise(r.cast("string"))
    return df.withColumn("requests", label).groupBy("requests").agg(_rate(), _n())


# fixed values: dashboard lead-time buckets (closed at 0)
DASH_LEAD = [(0, 14, "0–14 d"), (15, 30, "15–30 d"), (31, 60, "31–60 d"),
             (61, 90, "61–90 d"), (91, 150, "91–150 d")]
DASH_LEAD_TOP = "150+ d"


def dashboard_lead_buckets(df: DataFrame) -> DataFrame:
    lt = F.col("lead_time")
    expr = F.when(lt > 150, F.lit(DASH_LEAD_TOP))
    for lo, hi, label in reversed(DASH_LEAD):
        expr = F.when((lt >= lo) & (lt <= hi), F.lit(label)).otherwise(expr)
    return (df.withColumn("bucket", expr).where(F.col("bucket").isNotNull())
            .groupBy("bucket").agg(_rate(), _n()))


def price_by_room_type(df: DataFrame) -> DataFrame:
    return df.groupBy("room_type_reserved").agg(F.avg("avg_price_per_room").alias("avg_price"))


# ---------------------------------------------------------------------------
# distributions
# ---------------------------------------------------------------------------

def histogram(df: DataFrame, value: Column, bins: int, name: str = "value",
              by: list[str] | tuple = ()) -> DataFrame:
    """Equal-width histogram over [min, max] of each group (last bin closed on
    the right): (series, *by, bin, bin_lo, bin_hi, count, density), density =
    count / (n * width) as in a normalised plot. The per-group range rows are
    counted and broadcast within a bound, so that rows are never shuffled on
    a key of two or three values."""
    by = list(by)
    v = df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rng = v.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                             F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))),
                F.lit(bins - 1)))
    joined = v.join(bounded_broadcast(rng), by) if by else v.withColumns(scalars(rng))
    counts = (joined.withColumn("bin", idx.cast("bigint"))
              .groupBy(*by, "bin", "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("count")))
    return counts.select(
        F.lit(name).alias("series"), *by, "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        "count",
        F.try_divide(F.col("count").cast("double"), F.col("_n") * width).alias("density"))


def _quartiles(df: DataFrame, col: str, group: str) -> DataFrame:
    """(group, q1, median, q3): from brackets for a small domain, else from all distinct values."""
    probs = [0.25, 0.5, 0.75]
    series = grouped_series(df, col, group)
    if series is None:
        q = exact_quantiles(df, col, probs, [group])
    else:
        q = bracketed_quantiles(df, series, probs).withColumn(group, F.col("series").cast(df.schema[group].dataType))
    return q.groupBy(group).pivot("prob", probs).agg(F.first("value")).toDF(group, "q1", "median", "q3")


def box_stats_by_status(df: DataFrame, col: str = "avg_price_per_room",
                        group: str = "booking_status") -> DataFrame:
    """q1, median, q3 and Tukey whiskers (the extreme values inside
    q1 - 1.5 IQR and q3 + 1.5 IQR) per group: quartiles from brackets, whiskers in one more
    aggregate. The rows of a group are never gathered."""
    qw = _quartiles(df, col, group)
    fences = (qw.withColumn("_lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
              .withColumn("_hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    v = F.col(col)
    return (df.select(group, col).where(v.isNotNull()).join(bounded_broadcast(fences), group)
            .groupBy(group, "q1", "median", "q3")
            .agg(F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_lo"),
                 F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_hi")))


def violin_quartiles(df: DataFrame, col: str = "avg_price_per_room",
                     group: str = "booking_status") -> DataFrame:
    return _quartiles(df.where(F.col(col) > 0), col, group)


# ---------------------------------------------------------------------------
# rank statistics
# ---------------------------------------------------------------------------

def exact_u_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) without ties: of all ways to place n1 of n1 + n2 ranks, the share whose U is u or more.

    ways[v] counts the placements with U = v: the coefficients of the product of
    (1 - q^(n2 + i)) / (1 - q^i) for i = 1 .. n1, multiplied out factor by factor."""
    small, large = sorted((int(n1), int(n2)))
    size = small * large + 1
    ways = np.zeros(size)
    ways[0] = 1.0
    for i in range(1, small + 1):
        top = large + i
        if top < size:
            ways[top:] = ways[top:] - ways[:-top]
        for start in range(i):                      # division by 1 - q^i: running sums with stride i
            ways[start::i] = np.cumsum(ways[start::i])
    at = int(np.ceil(u - 1e-9))
    # the distribution is symmetric: sum the shorter end
    tail = ways[at:].sum() if at > size // 2 else ways.sum() - ways[:max(at, 0)].sum()
    return float(tail / ways.sum())


EXACT_SAMPLE, EXACT_CELLS = 8, 10_000_000


def mann_whitney(df: DataFrame, value: str = "avg_price_per_room",
                 group: str = "booking_status", first: str = "Not_Canceled",
                 second: str = "Canceled", alpha: float = 0.05) -> DataFrame:
    """Two-sided Mann-Whitney U test of ``value`` between two groups.

    Ranks come from distinct values with tie counts (no row-level sort); what
    reaches the driver is one row of sums. If a sample has at most 8 values, no two
    values are equal, and U has at most 10 million values, the p-value comes from the exact distribution of U,
    otherwise from the tie-corrected normal approximation with continuity
    correction, both in double precision. ``u_statistic`` is U of the first
    sample, ``method`` names the branch. With an empty sample z and p are null;
    if all values are equal, z is null and p is 1."""
    vr = value_ranks(df.where(F.col(group).isin(first, second)), value,
                     extra_counts={"n1": F.col(group) == first})
    s = vr.agg(F.sum(F.col("avg_rank") * F.col("n1")).alias("r1"),
               F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n2"),
               F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("tie_term")).first()
    n1, n2 = int(s["n1"] or 0), int(s["n2"] or 0)
    u1 = z = p = method = None
    if n1 and n2:
        n = n1 + n2
        u1 = s["r1"] - n1 * (n1 + 1) / 2
        top = max(u1, n1 * n2 - u1)
        variance = n1 * n2 / 12 * ((n + 1) - s["tie_term"] / (n * (n - 1)))
        z = (top - n1 * n2 / 2 - 0.5) / math.sqrt(variance) if variance > 0 else None
        if min(n1, n2) <= EXACT_SAMPLE and s["tie_term"] == 0 and n1 * n2 <= EXACT_CELLS:
            method, p = "exact", min(1.0, 2 * exact_u_tail(n1, n2, top))
        else:
            method, p = "asymptotic", 1.0 if z is None else min(1.0, math.erfc(z / math.sqrt(2.0)))
    return df.sparkSession.createDataFrame(
        [(u1, z, p, n1, n2, method, None if p is None else p < alpha)],
        "u_statistic double, z double, p_value double, n1 long, n2 long, method string, significant boolean")


def spearman_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "canceled": is_canceled(),
        "total_nights": F.col("no_of_weekend_nights") + F.col("no_of_week_nights"),
        "total_guests": F.col("no_of_adults") + F.col("no_of_children"),
    })


def _centred_ranks(base: DataFrame, cols: list[str], max_broadcast_rows: int) -> DataFrame:
    """``base`` (no nulls) with ``_r_<c>``: the average rank of each value, centred exactly.

    The rank tables come from one distributed pass over the distinct
    (column, value) pairs and are joined back by value. Each column is
    decided on its own: a table within ``max_broadcast_rows`` is broadcast,
    a larger one is a shuffle join (its values are not hot: it has many)."""
    ranks = value_ranks(_stack_numeric(base, cols), "value", ["column_name"])
    sizes = {r["column_name"]: (r["d"], r["n"]) for r in ranks.groupBy("column_name").agg(
        F.count("*").alias("d"), F.sum("n").alias("n")).collect()}   # one row per column
    rows = base
    for c in cols:
        distinct, n = sizes.get(c, (0, 0))
        rt = ranks.where(F.col("column_name") == c).select(
            F.col("value").alias(c), (F.col("avg_rank") - (n + 1) / 2.0).alias(f"_r_{c}"))
        rows = rows.join(F.broadcast(rt) if distinct <= max_broadcast_rows else rt, c, "left")
    return rows


def _pair_sums(rows: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str, float | None]]:
    """Correlation of centred ranks for each pair, from one aggregate."""
    cols = sorted({c for p in pairs for c in p})
    aggs = [F.sum(F.col(f"_r_{c}") * F.col(f"_r_{c}")).alias(f"ss|{c}") for c in cols]
    aggs += [F.sum(F.col(f"_r_{a}") * F.col(f"_r_{b}")).alias(f"{a}|{b}") for a, b in pairs]
    r = rows.agg(*aggs).first()
    out = []
    for a, b in pairs:
        den = math.sqrt((r[f"ss|{a}"] or 0.0) * (r[f"ss|{b}"] or 0.0))
        out.append((a, b, r[f"{a}|{b}"] / den if den else None))
    return out


def spearman_matrix(df: DataFrame, cols: list[str] = SPEARMAN_COLUMNS,
                    max_broadcast_rows: int = 200_000) -> DataFrame:
    """Spearman correlation (average ranks for ties) of every column pair, long
    format (row_feature, col_feature, rho).

    Nulls and NaN are left out pair by pair, as pandas does: a pair with a
    missing value in either column is ranked anew over its complete rows.
    Pairs of complete columns share one rank pass and one aggregate: average
    ranks of n rows always have mean (n + 1) / 2, so they are centred exactly
    and each correlation is sum(a b) / sqrt(sum(a^2) sum(b^2))."""
    def clean(c):
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v), v).alias(c)
    base = spearman_inputs(df).select(*[clean(c) for c in cols])
    counts = base.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in cols]).first()
    whole = [c for c in cols if counts[c] == counts["_all"]]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    full = [p for p in pairs if p[0] in whole and p[1] in whole]
    got = _pair_sums(_centred_ranks(base.select(*whole), whole, max_broadcast_rows), full) if full else []
    for a, b in pairs:
        if (a, b) not in full:
            both = base.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
            got += _pair_sums(_centred_ranks(both, [a, b], max_broadcast_rows), [(a, b)])
    rows = [(c, c, 1.0) for c in cols] + got + [(b, a, r) for a, b, r in got]
    return df.sparkSession.createDataFrame(
        rows, "row_feature string, col_feature string, rho double")   # #columns squared rows


def target_correlation_rank(matrix: DataFrame, target: str = "canceled") -> DataFrame:
    """|rho| of every feature with the target, ranked (1 = strongest)."""
    r = (matrix.where((F.col("row_feature") == target) & (F.col("col_feature") != target))
         .select(F.col("col_feature").alias("feature"), F.abs("rho").alias("abs_r")))
    w = Window.orderBy(F.desc("abs_r"), F.asc("feature"))  # at most #features rows
    return r.withColumn("rank", F.row_number().over(w).cast("bigint"))
