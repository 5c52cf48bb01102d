"""Dashboard table filters (P13) and report thresholds."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class FilterSpec:
    """Column filters of a dashboard table.

    ``contains``: case-insensitive text contains; ``equals``: dropdown
    equality; ``date_range``: ``from..to`` on dates, both ends inclusive
    (either may be None). Numbers have no filter, as in the reference.
    """
    contains: dict[str, str] = field(default_factory=dict)
    equals: dict[str, str] = field(default_factory=dict)
    date_range: dict[str, tuple] = field(default_factory=dict)


def _as_date(x):
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x).replace(".", "-"))


def filter_condition(spec: FilterSpec) -> Column:
    cond = F.lit(True)
    for c, text in spec.contains.items():
        if text:
            cond = cond & F.lower(F.col(c).cast("string")).contains(text.lower())
    for c, v in spec.equals.items():
        if v is not None:
            cond = cond & (F.col(c) == F.lit(v))
    for c, (lo, hi) in spec.date_range.items():
        d = F.to_date(F.col(c))
        if lo is not None:
            cond = cond & (d >= F.lit(_as_date(lo)))
        if hi is not None:
            cond = cond & (d <= F.lit(_as_date(hi)))
    return cond


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """One ``filter`` built from the spec (date bounds are literals, so a
    range on a timestamp column still prunes Parquet row groups)."""
    return df.filter(filter_condition(spec))


def min_operations(df: DataFrame, value: Column | str, threshold: int) -> DataFrame:
    """Drop groups under the "min operations" threshold (a ``HAVING``)."""
    v = F.col(value) if isinstance(value, str) else value
    return df.filter(v >= threshold)
