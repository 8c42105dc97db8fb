"""Scalar expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_in_order(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other; earlier ones win where they overlap."""
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


#: Station names and the prefixes that stand for them, the longer name first.
STATION_NAMES = [("Pronto shop 2", "PS-2"), ("Pronto shop", "PS-1"), ("8D OPS 02", "OPS-1")]


def joined_key(*parts: str | Column, by: str = "-") -> Column:
    return F.concat_ws(by, *parts)


def part_of(x: Column, n: int, by: str = "-") -> Column:
    """The ``n``-th part (from 1) of a joined key."""
    return F.split_part(x, F.lit(by), F.lit(n))


def scenario_of(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def clipped(x: Column, low: float = 0.0, high: float = 1e9) -> Column:
    """``x`` within bounds; a null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def calendar_parts(day: Column) -> dict[str, Column]:
    """ISO weekday (1 to 7), day of month, ISO week, month and calendar year."""
    return {
        "dayofweek": F.weekday(day) + 1,
        "dayofmonth": F.dayofmonth(day),
        "weekofyear": F.weekofyear(day),
        "monthofyear": F.month(day),
        "year": F.year(day),
    }


def price_change(before: Column, now: Column, direction: str = "previous_over_current") -> Column:
    """Relative price change; by default previous over current less one."""
    if direction == "previous_over_current":
        return F.try_divide(before, now) - 1
    if direction == "current_over_previous":
        return F.try_divide(now, before) - 1
    raise ValueError(direction)


def lag_number(column: str) -> int | None:
    """The number after ``lag`` in a feature name, None for other columns and rolling means."""
    found = re.search(r"lag(\d+)$", column)
    return int(found[1]) if found else None


def window_number(column: str) -> int | None:
    found = re.search(r"mavg(\d+)$", column)
    return int(found[1]) if found else None


def narrowed(kind: str) -> str:
    """Types kept for numbers: integers stay as they are, floats take single precision."""
    return "float" if kind in ("double", "float") else kind
