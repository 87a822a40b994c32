"""Dense positions of the rows of groups by one range exchange, however many rows a group has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def dealt_in_order(df: DataFrame, keys: Sequence[Column | str], name: str = "dealt", kept: Sequence[str] | None = None, parts: Sequence[int] = ()) -> DataFrame:
    """The rows written in ranges of ``keys``, sorted, with ``__part`` (the range) and ``__at`` (ascending in
    it), or of them only the columns ``kept``. Keys ascend with nulls first; equal keys lie in one range. There
    are as many ranges as ``parts`` (of ``tables.parts_for``) says."""
    at = F.monotonically_increasing_id()
    ranges = df.repartitionByRange(*parts, *keys).sortWithinPartitions(*keys).withColumn("__at", at)
    ranges = ranges if kept is None else ranges.select(*kept, "__at")
    return written(ranges, name).withColumn("__part", F.shiftright("__at", 33))


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], column: str = "pos", size: str | None = None, kept: Sequence[str] | None = None, parts: Sequence[int] = ()) -> DataFrame:
    """Each row with its position from 0 in its group (null is a group of its own) and, with ``size``, the
    group's number of rows. ``order`` should be total; with ``kept`` (the group among them) other columns go. A range's rows count on from those of the ranges
    before it: the table that is joined has a row per range and group, never a row per row. It is written, so
    that its size is known before the join is planned: while it is small, the rows are not shuffled again."""
    rows = dealt_in_order(df, [*group, *order], f"{column}-ranges", kept, parts)
    ahead = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    begin = counts.select(
        *(F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group)),
        F.col("__part").alias("__range"),
        (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(Window.partitionBy(*group)).alias("__size"),
    )
    begin = written(begin, f"{column}-begin")
    same = F.col("__part") == F.col("__range")
    for i, g in enumerate(group):
        same &= F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    placed = rows.join(begin, same).withColumn(column, F.col("__at") + F.col("__shift"))
    if size:
        placed = placed.withColumn(size, F.col("__size"))
    return placed.select(*(kept or df.columns), column, *[size] * bool(size))
