"""Rows of a large table that belong to a set of ids, without needless shuffles of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_IDS = 1_000_000
HEAVY_GROUPS = 1000


def split_by_ids(df: DataFrame, ids: DataFrame, on: list[str],
                 limit: int = BROADCAST_IDS) -> tuple[DataFrame, DataFrame]:
    """(rows with an id in ``ids``, the other rows). ids: distinct, columns ``on``.

    The ids are counted first: up to ``limit`` (a few MB) they are broadcast
    and the texts stay where they are; beyond it both sides are shuffled. The
    result is the same.
    """
    if ids.count() <= limit:
        ids = F.broadcast(ids)
    return df.join(ids, on, "left_semi"), df.join(ids, on, "left_anti")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join of rows with their group's row, for groups of any size.

    ``n`` is the number of rows of a group. Groups that hold more than
    1/HEAVY_GROUPS of all grouped rows are at most HEAVY_GROUPS in number,
    however large the input, and are broadcast: a hot group is never sent to
    one task. The other groups are shuffled.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    is_heavy = F.col(n) * HEAVY_GROUPS > total
    heavy = F.broadcast(groups.filter(is_heavy))
    rest = rows.join(F.broadcast(groups.filter(is_heavy).select(*on)), on, "left_anti")
    return rows.join(heavy, on).unionByName(rest.join(groups.filter(~is_heavy), on))
