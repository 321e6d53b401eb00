"""The bookings table: read from files, or derive it from the driver tables.

``FIXTURE_CTES`` is the booking-shaped view over ``orders``, ``customer`` and
``lineitem``: one row per order, 19 columns in source order, with a planted
label and price so that models have signal. The same text runs in Spark SQL
and in DuckDB, so the oracle queries and the Spark queries start from the
same rows.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from innsight.schema import BOOKING_SCHEMA
from innsight.session import scratch_path

# The view text. Table names appear as {orders}, {customer},
# {lineitem}; Spark binds DataFrames to them, the oracle uses the bare names.
FIXTURE_CTES = """
li AS (
  SELECT l_orderkey, COUNT(*) AS n_lines FROM {lineitem} GROUP BY l_orderkey
), base AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, CAST(o.o_orderdate AS DATE) AS d,
         o.o_orderpriority AS prio, cu.c_mktsegment AS seg,
         COALESCE(li.n_lines, 0) AS n_lines,
         (o.o_orderkey * 7919) % 444 AS lt0,
         CAST((o.o_orderkey * 48271) % 997 AS DOUBLE) / 997 AS u
  FROM {orders} o
  JOIN {customer} cu ON o.o_custkey = cu.c_custkey
  LEFT JOIN li ON o.o_orderkey = li.l_orderkey
), f AS (
  SELECT k, c, d, u,
         CASE WHEN k % 260 = 0 THEN 0 ELSE 1 + k % 4 END AS adults,
         CASE WHEN k % 5000 = 7 THEN 9 WHEN k % 12 = 0 THEN 1 + k % 3 ELSE 0 END AS children,
         c % 3 AS we, k % 5 AS wk,
         CASE WHEN k % 3000 = 11 THEN 'Meal Plan 3' WHEN prio = '1-URGENT' THEN 'Meal Plan 2'
              WHEN prio = '5-LOW' THEN 'Not Selected' ELSE 'Meal Plan 1' END AS meal,
         CASE WHEN k % 33 = 0 THEN 1 ELSE 0 END AS parking,
         CASE WHEN k % 3000 = 13 THEN 3 WHEN c % 7 IN (2) THEN 1 ELSE 1 + c % 7 END AS room_no,
         CAST(FLOOR(CAST(lt0 * lt0 AS DOUBLE) / 443) AS BIGINT) AS lead_time,
         YEAR(d) AS yr, MONTH(d) AS mo,
         CASE WHEN k % 97 = 0 THEN 31 ELSE DAY(d) END AS dom,
         CASE seg WHEN 'AUTOMOBILE' THEN 'Online' WHEN 'BUILDING' THEN 'Offline'
                  WHEN 'FURNITURE' THEN 'Corporate' WHEN 'HOUSEHOLD' THEN 'Complementary'
                  ELSE 'Aviation' END AS market,
         GREATEST(0, LEAST(5, n_lines - 3)) AS requests
  FROM base
), g AS (
  SELECT f.*,
         CASE WHEN CAST(lead_time AS DOUBLE) / 443 - 0.08 * requests + 0.3 * u > 0.42
              THEN 1 ELSE 0 END AS cancel,
         CASE WHEN k % 66 = 0 THEN CAST(0 AS DOUBLE)
              WHEN k % 7500 = 1 THEN CAST(540 AS DOUBLE)
              ELSE FLOOR((45 + 9 * room_no + 11 * adults + 6 * children
                          + CASE WHEN mo IN (6, 7, 8) THEN 14 ELSE 0 END + 30 * u) * 100) / 100
         END AS price
  FROM f
), h AS (
  SELECT g.*,
         COALESCE(SUM(cancel) OVER w, 0) AS prev_cancel,
         COALESCE(SUM(1 - cancel) OVER w, 0) AS prev_keep
  FROM g
  WINDOW w AS (PARTITION BY c ORDER BY d, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), bookings AS (
SELECT CONCAT('INN', LPAD(CAST(k AS STRING), 9, '0'))  AS Booking_ID,
       CAST(adults AS BIGINT)     AS no_of_adults,
       CAST(children AS BIGINT)   AS no_of_children,
       CAST(we AS BIGINT)         AS no_of_weekend_nights,
       CAST(wk AS BIGINT)         AS no_of_week_nights,
       meal                       AS type_of_meal_plan,
       CAST(parking AS BIGINT)    AS required_car_parking_space,
       CONCAT('Room_Type ', CAST(room_no AS STRING)) AS room_type_reserved,
       lead_time,
       CAST(yr AS BIGINT)         AS arrival_year,
       CAST(mo AS BIGINT)         AS arrival_month,
       CAST(dom AS BIGINT)        AS arrival_date,
       market                     AS market_segment_type,
       CAST(CASE WHEN prev_keep > 0 THEN 1 ELSE 0 END AS BIGINT) AS repeated_guest,
       CAST(prev_cancel AS BIGINT) AS no_of_previous_cancellations,
       CAST(prev_keep AS BIGINT)   AS no_of_previous_bookings_not_canceled,
       CAST(price AS DOUBLE)      AS avg_price_per_room,
       CAST(requests AS BIGINT)   AS no_of_special_requests,
       CASE WHEN cancel = 1 THEN 'Canceled' ELSE 'Not_Canceled' END AS booking_status
FROM h
)"""

_TABLES = ("orders", "customer", "lineitem")


def oracle_prefix() -> str:
    """``WITH <view CTEs>`` for DuckDB, where the driver tables are views."""
    return "WITH " + FIXTURE_CTES.format(**{t: t for t in _TABLES})


def _split_fixture() -> tuple[str, str]:
    """(CTEs up to ``g``, the final projection over ``h``) of the view text."""
    head, tail = FIXTURE_CTES.split("), h AS (", 1)
    final = tail[tail.index("), bookings AS (") + len("), bookings AS ("):].rstrip()
    return head + ")", final[:-1] if final.endswith(")") else final


def derive_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The booking view as a Spark plan over the driver's parquet tables.

    Same rows as the SQL text, with one change of plan: the per-customer
    running counts of earlier cancellations / kept bookings (a window
    partitioned by customer in the text) are computed as distributed prefix
    sums over the (customer, date, order) order. A customer holding a third
    of all orders is then spread over many range partitions instead of one
    window task."""
    from pyspark.sql import functions as F

    from innsight.operators.ranks import segmented_prefix_sums

    dfs = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in _TABLES}
    head, final = _split_fixture()
    g = spark.sql("WITH " + head + " SELECT * FROM g", **dfs)
    g = g.withColumn("_keep", 1 - F.col("cancel"))
    h = (segmented_prefix_sums(g, ["c"], ["d", "k"], ["cancel", "_keep"])
         .withColumnRenamed("cancel_before", "prev_cancel")
         .withColumnRenamed("_keep_before", "prev_keep").drop("_keep"))
    return spark.sql(final.replace("FROM h", "FROM {h}"), h=h)


def derive_bookings_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view text run as is by Spark SQL (reference plan for tests)."""
    dfs = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in _TABLES}
    return spark.sql("WITH " + FIXTURE_CTES + " SELECT * FROM bookings", **dfs)


_lock = threading.Lock()
_locks: dict[tuple[str, str, str], threading.RLock] = {}
_materialized: dict[tuple[str, str, str], str] = {}


def materialized(spark: SparkSession, name: str, sf_dir: str, build) -> DataFrame:
    """``build(spark, sf_dir)`` written once per application as Parquet under
    the shared checkpoint folder, then re-read. Later plans scan a columnar
    table (pushdown, pruning) and do not depend on the lineage that made it,
    so a lost executor never forces recomputing it. Different tables may be
    built at the same time."""
    key = (spark.sparkContext.applicationId, name, sf_dir.rstrip("/"))
    with _lock:
        own = _locks.setdefault(key, threading.RLock())
    with own:
        path = _materialized.get(key)
        if path is None:
            path = scratch_path(spark, name)
            build(spark, sf_dir).write.mode("overwrite").parquet(path)
            _materialized[key] = path
    return spark.read.parquet(path)


def replicated(df: DataFrame, copies: int) -> DataFrame:
    """``copies`` copies of the booking rows with distinct ids (for scaling
    runs); the copy number is appended to the id."""
    from pyspark.sql import functions as F
    out = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return out.withColumn("Booking_ID", F.concat(F.col("Booking_ID"), F.lit("-"),
                                                 F.col("_copy").cast("string"))).drop("_copy")


def bookings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The booking view, materialised once per application (see ``materialized``).

    ``sf_dir`` may end in ``#x<N>`` to use N copies of the view (scaling
    runs); every other table is derived from this one."""
    if "#x" in sf_dir:
        base, n = sf_dir.rsplit("#x", 1)
        df = materialized(spark, f"bookings-x{n}", sf_dir,
                          lambda s, _: replicated(bookings_table(s, base), int(n)))
    else:
        df = materialized(spark, "bookings", sf_dir, derive_bookings)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in BOOKING_SCHEMA.fields])


def read_bookings(spark: SparkSession, path: str, fmt: str = "csv",
                  corrupt_col: str | None = None) -> DataFrame:
    """Read a bookings file with the fixed schema (no inference).

    CSV is read with a header; malformed rows are kept with nulls
    (PERMISSIVE) so that the audit operators can count them, and with
    ``corrupt_col`` the raw text of each malformed line is kept in that
    column."""
    from pyspark.sql import types as T
    schema = BOOKING_SCHEMA
    reader = spark.read
    if corrupt_col:
        schema = T.StructType(list(schema.fields) + [T.StructField(corrupt_col, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_col)
    reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return reader.format(fmt).load(path)
