"""Joins that look keys up again where a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key is hot when it holds more than one in so many rows; there are at most that
#: many hot keys, which bounds what is broadcast
HOT_SHARE = 1000


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """rows joined with the row of ``table`` that has equal keys; rows without one
    are left out. ``table`` has one row per key and is read several times, so it
    should be a written one; its column ``n`` is the number of rows with that key,
    or any other weight. Hot keys are broadcast, the rest is a shuffle join however
    small it is, so nothing that grows with the data is broadcast. Column names other than the keys must differ. Null keys match nothing."""
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_hot = F.col(n) * HOT_SHARE > total
    hot, rest = table.where(is_hot).drop(n), table.where(~is_hot).drop(n)
    keys = list(keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(rest.hint("merge"), keys))


def small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table of short rows may be broadcast: its rows are counted, at
    most one more than the bound."""
    return df.limit(rows + 1).count() <= rows
