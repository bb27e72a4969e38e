"""Columns by name, whatever the names hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """``name`` as Spark reads it back, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct; ``"row.*"`` of it gives them back under their names."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])
