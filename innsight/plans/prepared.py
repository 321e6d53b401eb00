"""Spark-derived tables that several registered queries start from.

Each is written once per application to the shared checkpoint folder
(``materialized``): the cleaned rows with their split, and the price rows
with theirs. The deterministic score and price used to check evaluation
operators without a model are plain column expressions on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.operators.audit import load_and_clean
from innsight.operators.ranks import bounded_broadcast
from innsight.operators.split import assign_split
from innsight.sources.bookings import bookings_table, materialized


def _clean_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(load_and_clean(bookings_table(spark, sf_dir)), strata="label")


def _price_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_and_clean(bookings_table(spark, sf_dir)).where(F.col("avg_price_per_room") > 0)
    return assign_split(rows, strata=None)


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned bookings with label and stratified split (60/20/20)."""
    return materialized(spark, "clean_split", sf_dir, _clean_split)


def price_split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price-model rows (price > 0) with their unstratified split."""
    return materialized(spark, "price_split", sf_dir, _price_split)


def deterministic_prob(df: DataFrame) -> DataFrame:
    """A fixed probability from lead time, for checking evaluation operators
    without a fitted model."""
    return df.withColumn("prob", F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), F.col("lead_time").cast("double") / 443)))


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_table(spark, sf_dir).select("Booking_ID", "label", "split", "lead_time",
                                           "no_of_special_requests")
    return deterministic_prob(s)


def priced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows with a deterministic prediction: the training-split mean
    price of the row's market segment (a handful of rows, joined by key)."""
    p = price_split_table(spark, sf_dir)
    seg = (p.where(F.col("split") == "train").groupBy("market_segment_type")
           .agg(F.avg("avg_price_per_room").alias("predicted")))
    # one row per segment (a categorical domain, counted): broadcast, so a segment
    # holding a third of the rows never becomes one skewed shuffle partition
    return (p.join(bounded_broadcast(seg), "market_segment_type", "left")
            .select("Booking_ID", "split", "market_segment_type",
                    F.col("avg_price_per_room").alias("actual"), "predicted"))
