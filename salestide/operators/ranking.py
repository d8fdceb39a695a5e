"""Ordering by revenue: full ranking, top n, and the single best group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salestide.params import check_limit


def rank_by_revenue(groups: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Highest revenue first, equal revenue by key; at most ``limit`` rows.

    Revenue is compared as an exact decimal. A limit plans as a per-partition
    top n followed by a merge; without one this is a distributed range sort.
    """
    limit = check_limit(limit)
    ranked = groups.orderBy(F.desc("revenue"), F.asc(key))
    return ranked if limit is None else ranked.limit(limit)


def best_group(value: Column, revenue: Column, key: Column, among: Column) -> Column:
    """Aggregate: ``value`` of the row that ``rank_by_revenue`` would put first,
    among the rows where ``among`` holds; null when there are none.

    Struct comparison puts false before true and null before any value, hence
    the leading flag: a group without revenue loses to every other group.
    """
    order = F.struct(revenue.isNull(), -revenue, key)
    return F.min_by(value, F.when(among, order))
