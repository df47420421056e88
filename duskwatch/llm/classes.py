"""Joins of rows with the class they belong to, whatever share of the rows a class has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A class with at least this fraction (1 / SHARE) of all rows is broadcast, so at most SHARE classes are.
SHARE = 4096


def join_classes(rows: DataFrame, classes: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``classes`` on ``on``; rows without a class are left out.

    ``classes`` has one row per ``on`` and its number of rows in ``size``, ``total`` is the sum of the sizes.
    Classes of a large share are few by arithmetic and are broadcast; the others are joined by a shuffle, in
    which no key is large.
    """
    large = F.col(size) * SHARE >= total
    hot = F.broadcast(classes.where(large))
    rest = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on).union(rest.join(classes.where(~large), on))
