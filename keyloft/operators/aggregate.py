"""Aggregation into maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vmap import normalize_vmap, pair


def raw_map(key: Column, value: Column) -> Column:
    """Keys and values of a group as one vmap.

    Rows with a null or empty key are passed over; null values and duplicate keys
    are kept, equal keys in the order of their values, nulls first, so results do
    not depend on the order of a shuffle.  A group that has no key gives the empty map.
    """
    made = F.collect_list(F.when(key.isNotNull() & (key.cast("string") != ""), pair(key, value)))
    return normalize_vmap(F.array_sort(made))


def mapaggregate(df: DataFrame, key: str, value: str, *by: str) -> DataFrame:
    """A row for each group with its ``raw_map``; without ``by``, one for all rows."""
    made = raw_map(F.col(key), F.col(value)).alias("raw_map")
    return df.groupBy(*by).agg(made) if by else df.agg(made)
