"""Cross-sectional and temporal hierarchies as membership tables.

A hierarchy is an ordered list of levels, each the set of columns that it groups
by; levels may cross.  ``Total`` comes first and the bottom level last.  A
membership table has a row per level and member, so sums over nodes and back to
members are two joins, and only rows that exist take space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column sets of the store level, of all stores, and of time.
STORE_LEVELS = [["cat_id_enc"], ["dept_id_enc"], ["item_id_enc"]]
ALL_LEVELS = [
    ["state_id_enc"],
    ["store_id_enc"],
    ["cat_id_enc"],
    ["dept_id_enc"],
    ["state_id_enc", "cat_id_enc"],
    ["state_id_enc", "dept_id_enc"],
    ["store_id_enc", "cat_id_enc"],
    ["store_id_enc", "dept_id_enc"],
    ["item_id_enc"],
    ["item_id_enc", "state_id_enc"],
]
TIME_LEVELS = [["year"], ["year", "month"], ["year", "week"]]
TOTAL, BOTTOM = "Total", "bottom"


def joined(columns: list[str] | tuple[str, ...]) -> Column:
    """Values of ``columns`` joined by ``-``, different for different values.

    Of several parts a null is ``\\N``, and ``-`` and ``\\`` inside one have a ``\\`` in front; a single value stays as it is.
    """
    if len(columns) == 1:
        return F.coalesce(F.col(columns[0]).cast("string"), F.lit("\\N"))
    parts = [F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("-"), F.lit("\\-")) for c in columns]
    return F.concat_ws("-", *[F.coalesce(p, F.lit("\\N")) for p in parts])


@dataclass(frozen=True)
class Hierarchy:
    """Levels between Total and bottom, and the columns of a bottom member."""

    middle: tuple[tuple[str, ...], ...]
    bottom: tuple[str, ...]
    bottom_name: str = BOTTOM

    @classmethod
    def of(cls, levels: list[list[str]], bottom: list[str] | None = None, bottom_name: str = BOTTOM) -> Hierarchy:
        """``bottom`` defaults to the columns of all levels in order of first use."""
        columns = tuple(bottom or dict.fromkeys(c for level in levels for c in level))
        unknown = {c for level in levels for c in level} - set(columns)
        if unknown:
            raise ValueError(f"levels use columns that no bottom member has: {sorted(unknown)}")
        return cls(tuple(map(tuple, levels)), columns, bottom_name)

    def levels(self) -> list[tuple[int, str, Column]]:
        """``(level id, name, value)`` from Total to bottom."""
        out = [(0, TOTAL, F.lit(TOTAL))]
        out += [(i, "-".join(cols), joined(cols)) for i, cols in enumerate(self.middle, 1)]
        return [*out, (len(out), self.bottom_name, self.key())]

    def key(self) -> Column:
        return joined(self.bottom)

    @property
    def depth(self) -> int:
        return len(self.middle) + 2

    def nodes(self) -> Column:
        """The nodes that a row's member belongs to, as an array."""
        return F.array([F.struct(F.lit(i).alias("level_id"), F.lit(n).alias("aggregation"), v.alias("value")) for i, n, v in self.levels()])


def membership(members: DataFrame, hierarchy: Hierarchy, key: str = "member") -> DataFrame:
    """``(level_id, aggregation, value, <key>)`` of the distinct members of ``members``."""
    columns = dict.fromkeys([*hierarchy.bottom, *(c for level in hierarchy.middle for c in level)])
    distinct = members.select(*columns).distinct()
    return distinct.select(hierarchy.key().alias(key), F.explode(hierarchy.nodes()).alias("node")).select("node.*", key)


def node_sizes(sc: DataFrame, key: str = "member") -> DataFrame:
    """Members of each node."""
    return sc.groupBy("level_id", "aggregation", "value").agg(F.count(key).alias("n_members"))


def level_count(sc: DataFrame) -> DataFrame:
    return sc.agg(F.countDistinct("level_id").alias("n_levels"))


def restricted(st: DataFrame, first: str, last: str, key: str = "t") -> DataFrame:
    """A temporal membership within two dates, both included."""
    return st.where(F.col(key).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def aggregate_levels(facts: DataFrame, hierarchy: Hierarchy, by: list[str], measure: str) -> DataFrame:
    """Sums of ``measure`` for every node and ``by``: ``(level_id, aggregation, value, *by, <measure>)``.

    The facts are summed to bottom members first, so only that small result is
    repeated for each level, not the facts themselves.
    """
    bottom = facts.groupBy(*hierarchy.bottom, *by).agg(F.sum(measure).alias(measure))
    spread = bottom.select(*by, measure, F.explode(hierarchy.nodes()).alias("node")).select("node.*", *by, measure)
    return spread.groupBy("level_id", "aggregation", "value", *by).agg(F.sum(measure).alias(measure))


def aggregate_by_sets(facts: DataFrame, hierarchy: Hierarchy, by: list[str], measure: str) -> DataFrame:
    """The same sums as one GROUPING SETS aggregation."""
    sets = [[], *map(list, hierarchy.middle), list(hierarchy.bottom)]
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = facts.groupingSets([[*by, *s] for s in sets], *by, *columns).agg(F.sum(measure).alias(measure), F.grouping_id().alias("gid"))
    name, value, level = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (_, label, v) in enumerate(hierarchy.levels()):
        gid = sum(1 << (len(columns) - 1 - j) for j, c in enumerate(columns) if c not in sets[i])
        here = F.col("gid") == gid
        name, value, level = F.when(here, label).otherwise(name), F.when(here, v).otherwise(value), F.when(here, i).otherwise(level)
    return grouped.select(level.alias("level_id"), name.alias("aggregation"), value.alias("value"), *by, measure)


def aggregate_members(bottom: DataFrame, sc: DataFrame, by: list[str], measure: str, key: str = "member") -> DataFrame:
    """Sums over a membership table, for hierarchies that are not functions of columns; also bottom-up forecasts."""
    return bottom.join(sc, key).groupBy("level_id", "aggregation", "value", *by).agg(F.sum(measure).alias(measure))


def mean_over_members(bottom: DataFrame, sc: DataFrame, by: list[str], measures: list[str], key: str = "member") -> DataFrame:
    """Sums divided by the number of a node's members, whether these were observed or not."""
    sums = bottom.join(sc, key).groupBy("level_id", "aggregation", "value", *by).agg(*[F.sum(m).alias(m) for m in measures])
    joined = sums.join(node_sizes(sc, key), ["level_id", "aggregation", "value"])
    return joined.select("level_id", "aggregation", "value", *by, *[(F.col(m) / F.col("n_members")).alias(f"{m}_avg") for m in measures])
