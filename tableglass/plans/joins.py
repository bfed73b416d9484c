"""Looking up one row per group for every row of a large table, also when groups are many and uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 10_000_000  # a group with more rows than this is joined by broadcast
MOST_HOT = 100_000  # so many of them at most, the largest ones


def lookup(values: DataFrame, groups: DataFrame, by: Sequence[str], few: bool, rows: str = "n") -> DataFrame:
    """Each row of ``values`` with the row of its group.

    ``groups`` has one row per group and the group's number of rows in column ``rows``. ``few`` says
    that the groups were counted and can be broadcast. Otherwise only the hot groups are, so that none
    of them meets in one task, and the rows of all others are shuffled. ``tableglass.joins.hotRows`` changes what is hot.
    """
    on = list(by)
    if few:
        return values.join(F.broadcast(groups), on)
    limit = int(values.sparkSession.conf.get("tableglass.joins.hotRows", str(HOT_ROWS)))
    hot = groups.filter(F.col(rows) > limit).orderBy(F.desc(rows), *on).limit(MOST_HOT)
    keys = F.broadcast(hot.select(*on))
    others, cold = values.join(keys, on, "left_anti"), groups.join(keys, on, "left_anti")
    return values.join(F.broadcast(hot), on).unionByName(others.join(cold, on))
