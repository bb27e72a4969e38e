"""Queries over the test tables, one per operator, each with its SQL where SQL can say it."""

from driftline.catalog import (  # noqa: F401
    changes,
    configs,
    content,
    fleet,
    flows,
    groups,
    histories,
    links,
    properties,
    records,
    rows,
    streams,
)
from driftline.catalog.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
