"""Query registry: a Spark plan and, where one exists, an independent SQL
oracle for every operator key.

Spark results have every double column rounded to 6 decimals; the oracle
text rounds the columns listed in ``doubles`` the same way, so the two can be
compared value for value across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innsight.sources.bookings import oracle_prefix


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None          # SQL after the bookings CTEs
    doubles: list[str] = field(default_factory=list)


REGISTRY: dict[str, Query] = {}


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.round(F.col(f"`{f.name}`").cast("double"), places).alias(f.name))
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs)


def register(name: str, oracle: str | None = None, doubles: list[str] | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        build.__name__ = f"query_{name}"
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, oracle, list(doubles or []))
        return fn
    return deco


def oracle_text(q: Query) -> str | None:
    """Full DuckDB text: the bookings view CTEs, the query, 6-dp rounding."""
    if q.oracle is None:
        return None
    body = q.oracle.strip()
    if body.startswith(","):
        inner = oracle_prefix() + body
    else:
        inner = oracle_prefix() + "\n" + body
    if not q.doubles:
        return inner
    repl = ", ".join(f'ROUND(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in q.doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{inner}\n) AS q"
