"""Column expressions and small helpers shared by the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.session import scratch_path


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, every other character unchanged.

    Pure ASCII text takes Spark's byte-wise lower(); other text goes through
    translate(), because lower() would fold letters beyond A-Z too.
    """
    return (F.when(F.length(col) == F.octet_length(col), F.lower(col))
            .otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase)))


def other_columns(df: DataFrame, results: list[str]) -> list[str]:
    """Input columns that go along; one with the name of a result gives way to the result."""
    taken = {c.lower() for c in results}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Texts are long, so a session that has no setting of its own sends
    ``rows`` rows at once to Python instead of 10,000: the buffers on both
    sides stay at a few MB. Returns ``df``."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_ROWS, None) in (None, "10000"):
        spark.conf.set(BATCH_ROWS, str(rows))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
