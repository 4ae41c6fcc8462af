"""Named queries that apply the operators to the supplied tables, and their SQL."""

from . import facades, graphs, jobs, observed, pairs, rasters, statistics, survey, tables, texts  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
