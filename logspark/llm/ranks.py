"""Exact ranks in a global order, without a window over a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: monotonically_increasing_id() holds the partition above this bit and the row's place in it below.
PLACE_BITS = 33


def placed(rows: DataFrame) -> DataFrame:
    """rows with __part and __place: the partition, and the place in it. Only for rows that are written at once: the numbers follow the partitions."""
    at = F.monotonically_increasing_id()
    return rows.select("*", F.shiftrightunsigned(at, PLACE_BITS).alias("__part"), at.bitwiseAND((1 << PLACE_BITS) - 1).alias("__place"))


def ranked(rows: DataFrame, order: list[Column], group: str) -> DataFrame:
    """rows with `rank` (from 0, in that order within a group) and `n`, the rows of the group. order begins with the group.

    Rows are dealt by ranges of the whole order, sorted and written; the rows of a group before a partition are a prefix sum over counts by
    (group, partition). A group may hold any share of the rows, since it is never in one task. Rows that tie in all of order may change places.
    """
    own = cut(placed(rows.repartitionByRange(*order).sortWithinPartitions(*order)))
    count = own.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"), F.min("__place").alias("__least"))
    # a row for each partition of a group: its share of the rows is a partition's, not a row's
    before = Window.partitionBy("__g").orderBy("__p")
    base = count.select("__g", "__p", "__least", (F.sum("__n").over(before) - F.col("__n")).alias("__base"), F.sum("__n").over(Window.partitionBy("__g")).alias("n"))
    joined = own.join(base, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__place") - F.col("__least") + F.col("__base")).alias("rank"), "n")
