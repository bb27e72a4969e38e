"""Turning list columns into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(
    df: DataFrame, keep: list[str], items: Column | str, value: str, position: str = "_position"
) -> DataFrame:
    """One row per list entry with its position from 0; null and empty lists give none.

    A plain ``explode`` lets Spark infer a filter on the size of the list and push it
    down, which works out a computed list twice. The outer form with the filter on the
    position works it out once.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, value))
    rows = rows.where(F.col(position).isNotNull())
    return rows.drop("_position") if position == "_position" else rows
